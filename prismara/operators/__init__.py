"""Relational operators on pixels, masks, rays and recipes."""
