"""The one exception of the engine, with the codes a caller can tell apart."""

from __future__ import annotations

# The codes that clients know.
STATUS = {
    "InvalidIndex": 400,
    "InvalidIndexName": 400,
    "InvalidRequest": 400,
    "InvalidDocuments": 400,
    "InvalidQuery": 400,
    "InvalidAlias": 400,
    "InvalidSynonymMap": 400,
    "InvalidKnowledgeSource": 400,
    "InvalidKnowledgeBase": 400,
    "UnsupportedQuery": 400,
    "UnsupportedAction": 400,
    "ApiVersionMissing": 400,
    "ApiVersionUnsupported": 400,
    "AuthenticationFailed": 403,
    "ResourceNotFound": 404,
    "IndexAlreadyExists": 409,
    "SynonymMapAlreadyExists": 409,
    "AliasAlreadyExists": 409,
    "KnowledgeSourceAlreadyExists": 409,
    "KnowledgeBaseAlreadyExists": 409,
    "PreconditionFailed": 412,
    "InternalError": 500,
}


class SearchError(ValueError):
    """code: a key of STATUS; status: the HTTP status that goes with it."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.status, self.message = code, STATUS[code], message


def invalid(message: str) -> SearchError:
    return SearchError("InvalidQuery", message)
