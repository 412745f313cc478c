"""Errors of the library; the command line turns them into exit status 1."""


class ColligateError(Exception):
    """Something in the input or the options is not valid."""


class OptionError(ColligateError):
    """An option or a configuration value is not valid."""
