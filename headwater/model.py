"""Schemas of the relations that the operators read and write."""

from __future__ import annotations

NODES = "id long, shape array<long>, dtype string, ts_ns long, meta map<string,string>"
EDGES = "id long, op_name string, input_ids array<long>, output_id long, ts_ns long, meta map<string,string>, source_ids array<string>"
RANGES = "op_name string, input_node_id long, output_node_id long, input_shape array<long>, output_shape array<long>, full_range boolean"
GRADIENTS = "entry_seq long, sample_index long, source_id string, source_node_id long, loss double, vec array<double>"
ROW_LINEAGE = "sample_id long, table string, row_id long"
SCORES = "query_id long, sample_index long, source_id string, score double"
