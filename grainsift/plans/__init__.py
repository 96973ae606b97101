"""grainsift.plans"""
