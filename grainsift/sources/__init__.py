"""grainsift.sources"""
