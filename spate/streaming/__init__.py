"""spate.streaming"""
