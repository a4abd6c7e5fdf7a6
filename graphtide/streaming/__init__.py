"""graphtide.streaming"""
