"""postlens.streaming"""
