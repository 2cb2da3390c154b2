"""The relational operators that rules are made of, as functions on DataFrames."""

from ..plans.generic import extend_all
from ..plans.measured import agm_bound, join_measured, measure, wants_generic
from ..plans.planner import absorb_ears, atom_frame, drop_private, join_greedily, make_sets, reduce_fully
from ..rdf.dictionary import build_dictionary, decode, dense_ids, encode

__all__ = ["absorb_ears", "agm_bound", "atom_frame", "build_dictionary", "decode", "dense_ids", "drop_private", "encode", "extend_all", "join_greedily", "join_measured", "make_sets", "measure", "reduce_fully", "wants_generic"]
