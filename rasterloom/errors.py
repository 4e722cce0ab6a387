"""Errors that name what is wrong in a flow."""


class FlowError(ValueError):
    """A flow, a stage or its inputs are wrong."""


class ParamError(FlowError):
    """A parameter's value is wrong."""
