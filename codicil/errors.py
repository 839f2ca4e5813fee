"""Failures with a stable code."""

from __future__ import annotations


class PipelineError(Exception):
    def __init__(self, code: str, message: str, retryable: bool = False):
        super().__init__(message)
        self.code, self.message, self.retryable = code, message, retryable


class InvalidRequest(PipelineError):
    def __init__(self, message: str):
        super().__init__("invalid_request", message)


class NotFound(PipelineError):
    """code: act_not_found, provision_not_found or source_not_found."""


class Unavailable(PipelineError):
    def __init__(self, message: str):
        super().__init__("projection_unavailable", message, retryable=True)
