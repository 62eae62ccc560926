"""orewright.operators"""
