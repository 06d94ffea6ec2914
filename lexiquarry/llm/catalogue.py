"""Queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from lexiquarry.llm import bytebpe, bytesdedup, convrepair, decontam, fuzzylines, kdmeans, langid, mixing, secretscan, simhash, tokenbin, topk, windows

MODULES = (decontam, windows, langid, simhash, topk, mixing, fuzzylines, secretscan, tokenbin, bytesdedup, bytebpe, convrepair, kdmeans)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
