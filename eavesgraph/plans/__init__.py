"""Registered queries and their SQL counterparts."""

#: Modules of this package that hold QUERIES and ORACLE.
MODULES = ("geometry", "pipelines", "files", "dealt")
