"""spate.operators"""
