"""Explicit schemas of the data model, checked at load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


_S, _I, _L, _F, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.BooleanType()
CENTRE = T.ArrayType(T.ArrayType(T.ArrayType(_I)))
ENZYME = _struct(uniprot_id=_S, sequence=_S, ec=T.ArrayType(_S), validation_score=_D, existence=_S, reviewed=_S, organism=_S)
DATABASE_ENTRY = _struct(db=_S, id=_S)
CONTENTS = _struct(Entry=_S, Label=_S, Sequence=_S)
NEGATIVES = _struct(Entry=_S, Label=_S)
REACTION = _struct(smarts=_S, am_smarts=_S, am_chiral_smarts=_S, chiral_smarts=_S, min_rules=T.ArrayType(_S), rcs=CENTRE, enzymes=T.ArrayType(ENZYME), rhea_ids=T.ArrayType(_L), reverse=_L)
DIRECTIONS = _struct(RHEA_ID_MASTER=_L, RHEA_ID_LR=_L, RHEA_ID_RL=_L, RHEA_ID_BI=_L)
KNOWN_ENZYMES = _struct(id=_S, sequence=_S, existence=_S, reviewed=_S, subunit=_B)
KNOWN_REACTIONS = _struct(id=_S, smarts=_S, enzymes=T.ArrayType(_S), db_ids=T.ArrayType(_S))
MAPPED = _struct(rxn_id=_S, rule_id=_I, rule=_S, smarts=_S, am_smarts=_S, template_aidxs=_S)
PAIRS = _struct(protein_idx=_I, reaction_idx=_I, pid=_S, rid=_S, protein_embedding=T.ArrayType(_F), smarts=_S, am_smarts=_S, reaction_center=CENTRE, y=_I)
PREDICTIONS = _struct(protein_idx=_I, reaction_idx=_I, pid=_S, rid=_S, y=_I, logits=_D, max_sim=_D)
THRESHOLDS = _struct(run_id=_S, neg_multiple=_I, threshold=_D)
METRICS = _struct(data=_S, model=_S, neg_multiple=_I, metric=_S, mean=_D, ci_lower=_D, ci_upper=_D, id=_S)


def validated(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` in its order and types; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])


def flat_name(*levels: str) -> str:
    """One column name of the levels of a nested one; empty levels are left out."""
    return "_".join(str(x) for x in levels if str(x))


def flatten_config(tree: dict, separator: str = "/", prefix: str = "") -> dict:
    """Nested settings as 'a/b' keys."""
    out: dict = {}
    for k, v in tree.items():
        name = f"{prefix}{separator}{k}" if prefix else str(k)
        out.update(flatten_config(v, separator, name)) if isinstance(v, dict) else out.__setitem__(name, v)
    return out


def unflatten_config(flat: dict, separator: str = "/") -> dict:
    """The tree again; texts become int, then float, 'None' becomes null."""
    def scalar(v):
        if not isinstance(v, str):
            return v
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return None if v == "None" else v

    tree: dict = {}
    for name, v in flat.items():
        *path, last = name.split(separator)
        node = tree
        for p in path:
            node = node.setdefault(p, {})
        node[last] = scalar(v)
    return tree
