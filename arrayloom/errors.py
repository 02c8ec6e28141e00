"""One exception hierarchy; every error knows where it arose and in which step."""

from __future__ import annotations

import warnings


class EngineError(Exception):
    """Base of all errors; location is 'function:what', step and type name the pipeline step."""

    def __init__(self, message: str, location: str | None = None, step: int | None = None, type: str | None = None):
        super().__init__(message)
        self.location, self.step, self.type = location, step, type

    def __str__(self) -> str:
        where = [] if self.step is None else [f"step {self.step}" + (f" ({self.type})" if self.type else "")]
        return super().__str__() + "".join(f" [{x}]" for x in [*where, *filter(None, [self.location])])


class ValidationError(EngineError):
    """A value breaks a rule that can be stated in advance."""


class InvalidParameters(ValidationError):
    """A step's parameters are unknown, missing or out of range."""


class InvalidInput(ValidationError):
    """Data that a step can't take, such as non-finite values."""


class DimensionMismatch(ValidationError):
    """Two arrays that should fit don't."""


class RunIdError(ValidationError):
    """A run id is malformed or unknown."""


class DescriptorError(EngineError):
    """A step descriptor can't be understood."""


class JsonParseError(DescriptorError):
    """A descriptor isn't JSON."""


class SequenceError(DescriptorError):
    """Descriptors aren't numbered 0, 1, 2, ..."""


class ContractError(EngineError):
    """A step asked for a dataset that no earlier step made."""


class MissingPath(EngineError):
    """A dataset isn't in the archive."""


class MissingData(EngineError):
    """A dataset is there, but empty or without values."""


class NoMethod(EngineError):
    """No transform is registered under a type."""


class NotSupported(EngineError):
    """A parameter value that the format names but nothing implements."""


class DependencyError(EngineError):
    """Something optional isn't installed."""


class Float16Unsupported(DependencyError):
    """Half precision isn't a column type."""


class StepError(EngineError):
    """A step failed; the cause is chained."""


class StepReturnError(EngineError):
    """A step returned something that isn't a frame."""


class DuplicateKey(EngineError):
    """A dataset path is used twice in one archive."""


class ArchiveExists(EngineError):
    """The target folder holds an archive."""


class ClosedReader(EngineError):
    """A reader was used after close()."""


class EngineWarning(UserWarning):
    """Base of all warnings."""


class ParameterAdjusted(EngineWarning):
    """A parameter was clipped to what the data allow."""


class DataQuality(EngineWarning):
    """Values were clipped or look wrong."""


class MaskMismatch(EngineWarning):
    """An archive was made with another mask."""


class Overwritten(EngineWarning):
    """A named result was replaced."""


class MissingMethod(EngineWarning):
    """A step's type isn't registered and was skipped."""


class MissingAttribute(EngineWarning):
    """A field was absent and a default was used."""


def warn(message: str, kind: type[EngineWarning] = EngineWarning) -> None:
    warnings.warn(message, kind, stacklevel=3)
