"""spate.functions"""
