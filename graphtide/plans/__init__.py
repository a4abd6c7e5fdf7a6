"""graphtide.plans"""
