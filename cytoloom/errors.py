"""Errors by what went wrong; the command line turns them into exit code 1 (2 for usage)."""


class EngineError(Exception):
    kind = "engine"


class ConfigurationError(EngineError):
    kind = "configuration"


class InputError(EngineError):
    kind = "input"


class CallingError(EngineError):
    kind = "calling"


class OutputError(EngineError):
    kind = "output"


class PublicationError(OutputError):
    kind = "publication"
