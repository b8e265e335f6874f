"""shalecrest.functions"""
