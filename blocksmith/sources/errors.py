"""What can go wrong with a file."""


class StorageError(Exception):
    """Base of all errors of the format."""


class InvalidMagic(StorageError):
    """The header or the trailer isn't that of this format and version."""


class InvalidMetadata(StorageError):
    """The footer or a chunk contradicts itself or the schema."""


class ChecksumMismatch(StorageError):
    """The footer's CRC-32C is another."""


class UnexpectedEnd(StorageError):
    """Bytes are missing."""


class NumberOverflow(StorageError):
    """A count or value leaves its integer type."""


class BlockOutOfRange(StorageError):
    """There is no block of that number."""


class SchemaChanged(StorageError):
    """A batch has another schema than the file."""
