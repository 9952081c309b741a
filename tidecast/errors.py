"""Errors that the library raises on purpose."""


class TidecastError(Exception):
    """Base of them all."""


class HorizonError(TidecastError, ValueError):
    """A horizon that is missing, contradictory, or asked for outside a model body."""


class AlignmentError(TidecastError, ValueError):
    """Tables whose time, keys or covariates do not line up."""


class MethodResolutionError(TidecastError, ValueError):
    """An inference method, optimizer or backend that is not known."""


class BacktestWindowError(TidecastError, ValueError):
    """Backtest windows that cannot be formed."""


class NotFittedError(TidecastError, RuntimeError):
    """A predictive call before fit()."""


class OptionalDependencyError(TidecastError, ImportError):
    """A package that an optional feature needs is missing."""


class ConvergenceWarning(UserWarning):
    """A variational fit whose loss still falls, or can't be told to have settled."""
