"""Text folding inside the JVM: compatibility decomposition and full case folding without a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _icu(method: str, *args: Column) -> Column:
    name, _, function = method.rpartition(".")
    return F.java_method(F.lit(f"com.ibm.icu.{name}"), F.lit(function), *args)


def decomposed(text: Column) -> Column:
    """NFKD without combining marks; plain ASCII texts are left as they are. Null stays null."""
    whole = F.regexp_replace(_icu("text.Normalizer.decompose", F.coalesce(text, F.lit("")), F.lit(True)), r"\p{M}+", "")
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).when(text.isNotNull(), whole)


def case_folded(text: Column) -> Column:
    """Full Unicode case folding (``ß`` gives ``ss``). Null stays null."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).when(text.isNotNull(), _icu("lang.UCharacter.foldCase", F.coalesce(text, F.lit("")), F.lit(True)))
