"""radweave.streaming"""
