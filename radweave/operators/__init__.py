"""radweave.operators"""
