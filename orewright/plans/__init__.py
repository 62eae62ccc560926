"""orewright.plans"""
