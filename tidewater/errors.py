"""What can go wrong, by kind."""


class EngineError(Exception):
    """Any error that the engine raises itself."""


class ParseError(EngineError):
    """The statement can't be read, or is of no supported kind."""


class BindingError(EngineError):
    """A table, column or parameter that there isn't, or one too many."""


class TypeMismatchError(EngineError):
    """A value that doesn't fit its column."""


class ConstraintError(EngineError):
    """A null where none may be, a vector of the wrong dimension, a key that exists."""


class TransactionError(EngineError):
    """A commit that can't take place."""


class ConflictError(TransactionError):
    """Another commit has changed the same rows first."""


class PlanningError(EngineError):
    """No plan or estimate can be made."""


class IndexBuildError(EngineError):
    """An index can't be built or searched."""
