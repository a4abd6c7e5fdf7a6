"""graphtide.operators"""
