"""grainsift.operators"""
