"""shalecrest.streaming"""
