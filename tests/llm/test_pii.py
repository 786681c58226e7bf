import hashlib
import random
import re

from tabveil.llm.pii import pseudonymise


KEY = "a key of the tests"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def one(spark, *texts):
    return pseudonymise(spark.createDataFrame([(n, t, "k") for n, t in enumerate(texts)], "doc_id long, text string, n_found string"), KEY).orderBy("doc_id").collect()


def test_formats_links_and_checks(spark):
    card = "4539 1488 0343 6467"
    a, b, c, d, e, f, g = one(
        spark,
        f"pay {card} or 10.0.0.255, call +1 (017) 555-7713 on 2024-02-29.",
        f"x {card} y 10.0.0.255 z +1 (017) 555-7713 und 29.02.2024",
        "mail Jo.Doe7@mail7.example.com twice jo.doe7@mail7.example.com, 078-05-1120",
        "bad 4539148803436468 and 999.1.1.1 and 2023-02-30",
        "IBAN GB82 WEST 1234 5698 7654 32 and token 04dbebab91ab85687d33eeaaf9ac699e1188f962",
        None,
        "plain words, 12 of them",
    )
    new = re.search(r"pay ([\d ]{19}) or ([\d.]+), call (\+\d \(\d{3}\) \d{3}-\d{4}) on (\d{4}-\d\d-\d\d)\.", a.text)
    assert a.n_found == 4 and new and new[1] != card and luhn(new[1]) % 10 == 0
    assert all(int(x) < 256 for x in new[2].split("."))
    assert f"x {new[1]} y {new[2]} z {new[3]} und" in b.text and b.n_found == 4
    y, m, dd = new[4].split("-")
    assert b.text.endswith(f"{dd}.{m}.{y}")
    m = re.findall(r"[a-z0-9.]+@[a-z0-9.]+\.com", c.text)
    m = re.findall(r"[A-Za-z0-9.]+@[a-z0-9.]+\.com", c.text)
    assert len(m) == 2 and m[0].lower() == m[1] and "doe7" not in c.text and "078-05-1120" not in c.text and c.n_found == 3
    assert d.text == "bad 4539148803436468 and 999.1.1.1 and 2023-02-30" and d.n_found == 0
    p = re.search(r"IBAN (GB\d\d (?:[A-Z0-9]{4} ){4}[A-Z0-9]{2}) and token ([0-9a-f]{40})$", e.text)
    assert p and p[1] != "GB82 WEST 1234 5698 7654 32" and e.n_found == 2
    x = p[1].replace(" ", "")
    assert int("".join(str(int(ch, 36)) for ch in x[4:] + x[:4])) % 97 == 1
    assert (f.text, f.n_found) == (None, 0) and (g.text, g.n_found) == ("plain words, 12 of them", 0)


def test_a_permutation(spark):
    rows = [r.text for r in one(spark, *[f"+1 555-{i:04d}" for i in range(3000)])]
    assert len(set(rows)) == 3000
    days = [r.text for r in one(spark, *[f"{y}-{m:02d}-11" for y in range(1000, 3000, 9) for m in range(1, 13)])]
    assert len(set(days)) == len(days)
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).collect() == []


def test_values_side_by_side(spark):
    phone, ip, card, iban = "+1 (826) 555-4081", "190.137.223.204", "4111 1111 1111 1111", "BE68539007547034"
    new = {v: r.text for v, r in zip((phone, ip, card, iban, "2024-02-29", "378282246310005", "BE68 5390 0754 7034"), one(spark, phone, ip, card, iban, "2024-02-29", "378282246310005", "BE68 5390 0754 7034"))}
    assert all(v != n for v, n in new.items())
    texts = [(phone, " ", ip), (phone, " ", "2024-02-29"), (phone, " ", card), (card, " 12/27"), ("12 ", card, " 345"), (iban, " OK"), ("BE68 5390 0754 7034", " SOME WORDS"), ("BE68 5390 0754 7034", " ", card), ("378282246310005", " ", card), ("AB12 ", card)]
    for parts, r in zip(texts, one(spark, *["".join(x) for x in texts])):
        assert r.text == "".join(new.get(x, x) for x in parts) and r.n_found == sum(x in new for x in parts), parts
    a, b, c = one(spark, "key 04DBEBAB91AB85687D33EEAAF9AC699E", "key 04dbebab91ab85687d33eeaaf9ac699e", "no 4111 1111 1111 1112 12/27")
    assert re.fullmatch("key [0-9A-F]{32}", a.text) and a.n_found == 1 and a.text[4:].lower() == b.text[4:] != "04dbebab91ab85687d33eeaaf9ac699e"
    assert c.text == "no 4111 1111 1111 1112 12/27" and c.n_found == 0


def test_long_and_hostile_texts(spark):
    n, m = 2_000, 200_000
    texts = ["x@" + "a." * m + "com", "x@" + "a" * m, "a@" * m, "1 " * n, "1-" * n, "+1 " * n, "AB12 " + "CD34 " * n, "0123456789abcdef" * (n // 8), "1.2.3." * (n // 4), "2024-01-0" * (n // 8), ("word " * 20 + "+1 555-0100 ") * (n // 100)]
    got = one(spark, *texts)
    assert [r.text for r in got[:3]] == texts[:3] and all(len(r.text) == len(t) for r, t in zip(got, texts))
    assert got[-1].n_found == n // 100 and len(set(re.findall(r"\+[0-9 -]+[0-9]", got[-1].text))) == 1


def feistel(label, left, right, m, n):
    """Written anew, from the rule that the docstrings state."""
    digest = lambda i, x: int(hashlib.sha256(f"{KEY}|{label}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(4):
        left = (left + digest(i, right) % m) % m
        right = (right + digest(i + 4, left) % n) % n
    return left, right


def digits_of(label, digits):
    a = len(digits) // 2
    left, right = feistel(f"{label}{len(digits)}", int(digits[:a] or 0), int(digits[a:]), 10**a, 10 ** (len(digits) - a))
    return (str(left).zfill(a) if a else "") + str(right).zfill(len(digits) - a)


def put(value, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def test_against_brute_force(spark):
    r = random.Random(8)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows, want = [], []
    for n in range(60):
        phone, ssn, ip, body = f"+1 ({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(2)}-{number(4)}", ".".join(str(r.randint(0, 255)) for _ in range(4)), number(15)
        card = next(body + str(d) for d in range(10) if luhn(body + str(d)) % 10 == 0)
        a, b, c, d = map(int, ip.split("."))
        left, right = feistel("ip", a * 256 + b, c * 256 + d, 65536, 65536)
        head = digits_of("card", body)
        new = [put(phone, digits_of("phone", re.sub("[^0-9]", "", phone))), put(ssn, digits_of("ssn", ssn.replace("-", ""))), f"{left // 256}.{left % 256}.{right // 256}.{right % 256}", next(head + str(d) for d in range(10) if luhn(head + str(d)) % 10 == 0)]
        words = [f"word{'xyz'[n % 3]}" for _ in range(5)]
        rows.append(" ".join(x for p in zip(words, [phone, ssn, ip, card, ""]) for x in p))
        want.append(" ".join(x for p in zip(words, [*new, ""]) for x in p))
    got = one(spark, *rows, *rows)
    assert [x.text for x in got] == want * 2


def test_many_cards_in_one_row_of_groups(spark):
    r = random.Random(8)

    def card():
        d = "4" + "".join(r.choice("0123456789") for _ in range(14))
        d += str(-luhn(d + "0") % 10)
        return " ".join(d[i : i + 4] for i in range(0, 16, 4))

    cards = [[card() for _ in range(4)] for _ in range(5)]
    got = one(spark, *(f"paid {' '.join(c)} 1111 1111 1113 so far" for c in cards), f"odd {' '.join(['1112'] * 8)} {cards[0][0]} 7 8 9")
    assert [x.n_found for x in got] == [4] * 5 + [1]
    assert not any(c in x.text for x, mine in zip(got, [*cards, cards[0][:1]], strict=True) for c in mine)
