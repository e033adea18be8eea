"""Schemas, value sets and settings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANGUAGES = ("rust", "typescript", "javascript", "python", "json", "markdown", "unknown")
CHUNK_KINDS = ("code", "comment", "doc", "diagnostic", "selection")
NODE_KINDS = ("file", "function", "method", "class", "import")
EDGE_KINDS = ("contains", "calls", "imports", "inherits", "tests")
STRATEGIES = ("greedy", "knapsack_dp", "mmr_submodular", "auto")
DEPENDENCY_KINDS = ("calls", "imports", "inherits")

CHUNK = "id string, pos long, path string, language string, content string, kind string, priority int, skeleton_hint boolean, community int"
REQUEST = "chunks array<struct<id:string,path:string,language:string,content:string,kind:string,priority:int,skeleton_hint:boolean,community:int>>, query string"
NODE = "id long, kind string, name string, qualified string, path string, language string, start_line int, end_line int, signature string, body_bytes long"
EDGE = "src long, dst long, kind string, confidence double"
FILE = "path string, sha256 string, language string, last_indexed long"
USAGE = "ts long, in_tokens long, out_tokens long, saved_tokens long, elapsed_ms double, query string, chunks_in long, chunks_out long, source string, project string"

#: Confidences of edges are single precision, widened.
CONFIDENCE = {k: float(np.float32(v)) for k, v in {"contains": 1.0, "imports": 1.0, "inherits": 0.8, "calls": 0.7}.items()}


@dataclass(frozen=True)
class Config:
    max_tokens: int = 8000
    skeleton: bool = True
    dedup: bool = True
    compress: bool = True
    rank: bool = True
    budget: bool = True
    #: Single precision, widened: a similarity of exactly 23/25 stays below it.
    dedup_similarity: float = float(np.float32(0.92))
    strategy: str = "auto"
    mmr_lambda: float = 0.7
    cache_order: bool = True
    rm3: bool = False
    community_budget: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
