"""postlens.operators"""
