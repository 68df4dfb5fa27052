"""Engine parameters with the documented defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    """Immutable settings; ``with_chunking`` applies the documented clamps."""

    dimension: int = 1024
    enable_chunking: bool = True
    chunk_size: int = 512
    chunk_overlap: int = 128
    chunk_mode: str = "compat"
    initial_k: int = 20
    final_k: int = 5
    depth: int = 1
    seed_limit: int = 10
    secondary_factor: int = 3
    direct_chunk_k: int = 10
    chunk_limit: int = 5
    overfetch: int = 3
    stm_capacity: int = 20
    weighting: str = "uniform"
    hybrid: bool = False

    def with_chunking(self, size: int, overlap: int) -> EngineConfig:
        """Chunk size is at least 50 and the overlap at most half of it."""
        size = max(50, size)
        return replace(self, chunk_size=size, chunk_overlap=min(overlap, size // 2))
