"""The declared graph of named sources and derived nodes, and questions about its shape."""

from millrace.graph.blueprint import Blueprint, CycleError, Node

__all__ = ["Blueprint", "CycleError", "Node"]
