"""Errors that callers may want to tell apart."""


class FolioError(RuntimeError):
    """Base of the library's own errors."""


class ChannelError(FolioError):
    """A channel that an object does not have, or of a type that cannot be read."""


class DatasetExists(FolioError):
    """The dataset is there already and the builder was told to fail then."""


class EmptyDataset(FolioError):
    """A dataset without keys was about to be written."""


class MissingOption(FolioError):
    """An option that is given neither as an argument, in Spark's configuration nor in the environment."""


class ModelError(FolioError):
    """A model that cannot be found, told apart or loaded."""


class ForceAcknowledge(Exception):
    """Raised by a message handler to take its message off the queue though it failed."""
