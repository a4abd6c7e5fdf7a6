"""graphtide.sources"""
