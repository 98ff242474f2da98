"""Pipeline parameters.

The reference reads these from a YAML file; here they are a frozen dataclass,
so a plan is a pure function of (input tables, Config).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # --- fixed values that must equal the reference's for equal results ---
    min_article_len: int = 200          # inclusive, code points
    max_article_len: int = 15000        # inclusive, code points
    min_article_words: int = 15         # inclusive
    max_article_words: int | None = None  # absent in the shipped config: unbounded
    allowed_languages: tuple[str, ...] = ("hu", "cs", "sk")
    min_article_sentences: int = 3      # defined in the reference, never called
    char_ngram: int = 9                 # shingle width, in UTF-8 bytes
    num_perm: int = 200                 # MinHash signature length
    num_bands: int = 10                 # LSH bands (20 rows each)
    min_jaccard: float = 0.35           # verification threshold (>=)
    train_size: float = 0.8
    valid_size: float = 0.1
    split_seed: int = 123
    max_seq_len: int = 512              # encoder/decoder length
    year_max: int = 2023                # yearly counts keep year <= this
    # --- ours ---
    crawl_epoch: str = "2021-07-24"     # documents adapter: crawl date = epoch + doc_id days
    exact_jaccard: bool = False         # D5 option: verify on shingle sets instead of signatures
    shingle_hash: str = "md5"           # "md5" (DuckDB can recompute it) or "xxhash64" (about 3x cheaper)
    vocab_size: int | None = None       # word vocabulary for encoding (E2); None: every word
    hist_bins: int = 100
    sites: tuple[str, ...] = field(default_factory=tuple)  # empty = all

    @property
    def rows_per_band(self) -> int:
        return self.num_perm // self.num_bands

    @property
    def min_agree(self) -> int:
        """Smallest number of equal signature slots that passes ``min_jaccard``."""
        import math

        return int(math.ceil(self.min_jaccard * self.num_perm - 1e-9))


DEFAULT = Config()
