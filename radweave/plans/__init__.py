"""radweave.plans"""
