"""The one exception that users of the library see."""


class ExtractionError(ValueError):
    """A recipe, a book or a record breaks a rule."""
