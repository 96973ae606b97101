"""grainsift.functions"""
