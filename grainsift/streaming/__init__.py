"""grainsift.streaming"""
