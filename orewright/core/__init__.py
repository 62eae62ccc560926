"""orewright.core"""
