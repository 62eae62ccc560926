"""orewright.functions"""
