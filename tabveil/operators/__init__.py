"""tabveil.operators"""
