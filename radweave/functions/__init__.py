"""radweave.functions"""
