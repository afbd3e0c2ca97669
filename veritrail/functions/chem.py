"""Canonical structures. The library that computes them is optional; without it the answer is null, never a guess."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StructType().add("canonical", T.StringType()).add("key", T.StringType()).add("available", T.BooleanType()))
def structure(smiles: pd.Series) -> pd.DataFrame:
    """Canonical SMILES and InChIKey; ``available`` tells whether they could be computed at all."""
    try:
        from rdkit import Chem
    except ImportError:
        return pd.DataFrame({"canonical": [None] * len(smiles), "key": [None] * len(smiles), "available": [False] * len(smiles)})
    molecules = [Chem.MolFromSmiles(s) if s else None for s in smiles]
    return pd.DataFrame({
        "canonical": [Chem.MolToSmiles(m) if m else None for m in molecules],
        "key": [Chem.MolToInchiKey(m) if m else None for m in molecules],
        "available": [True] * len(smiles),
    })
