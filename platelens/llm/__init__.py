"""Operators for preparing training text: near copies, sharding, token counts, extraction, quality, mixing,
decontamination, language identification, nearest neighbours and repeated passages."""
