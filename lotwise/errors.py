"""Errors raised after one aggregate has shown that the input is unusable."""


class InputError(ValueError):
    """A process or QC table cannot be used as supplied."""


class LimitTableError(ValueError):
    """A limits table cannot be used as supplied."""
