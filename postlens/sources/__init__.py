"""postlens.sources"""
