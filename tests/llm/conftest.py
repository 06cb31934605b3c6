import pytest


@pytest.fixture(autouse=True)
def small_tables(monkeypatch):
    """Tables of ranks and bits of a size that suits small inputs; they change how much is compared, and no result."""
    from siltstone.llm import lines, sieve

    monkeypatch.setattr(lines, "RARITY_BUCKETS", 1 << 12)
    monkeypatch.setattr(sieve, "BITS", 1 << 13)
    monkeypatch.setattr(sieve, "WORDS", 1 << 7)
