"""tabveil.sources"""
