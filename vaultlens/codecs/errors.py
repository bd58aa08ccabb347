"""The error that codecs and parsers raise for malformed bytes."""


class MalformedError(ValueError):
    """Bytes that don't follow their format."""
