"""Operations of a training-data pipeline over `documents`, `pages` and `labels`.

Nothing outside this package imports it, and it can be removed as a whole.
"""
