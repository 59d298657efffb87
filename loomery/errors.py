"""Exceptions raised while a plan is being built; data problems become columns instead."""


class LoomeryError(Exception):
    """Base of everything this package raises on purpose."""


class BadRequest(LoomeryError):
    """A parameter makes no sense."""


class NotThere(LoomeryError):
    """Something that had to exist does not."""


class TooLate(LoomeryError):
    """An event came after its pane was sealed."""


class Stopped(LoomeryError):
    """The component is closed, fenced or cannot converge."""
