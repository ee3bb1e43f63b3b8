"""postlens.functions"""
