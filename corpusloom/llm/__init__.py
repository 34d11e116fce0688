"""Training-data operators: one module per operator, and ``queries`` for the registered ones.

Nothing outside this folder imports it; remove the folder and the rest of the library still works.
"""
