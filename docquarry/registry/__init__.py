"""Queries over the driver's tables, each next to the SQL that checks it."""

from docquarry.registry import evaluation, flows, grounding, index, retrieval, texts, upkeep

MODULES = [retrieval, texts, index, upkeep, grounding, evaluation, flows]
