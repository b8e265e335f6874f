"""shalecrest.sources"""
