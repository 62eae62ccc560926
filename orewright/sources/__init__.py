"""orewright.sources"""
