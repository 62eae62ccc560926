"""orewright.streaming"""
