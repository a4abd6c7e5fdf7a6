"""graphtide.functions"""
