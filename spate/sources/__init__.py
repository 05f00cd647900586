"""spate.sources"""
