"""postlens.plans"""
