"""radweave.sources"""
