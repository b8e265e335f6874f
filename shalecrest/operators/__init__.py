"""shalecrest.operators"""
