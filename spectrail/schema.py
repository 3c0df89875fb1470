"""Schemas of the entities."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = "struct<start:int,end:int,text:string>"
METHOD = "struct<algorithm:string,version:string,confidence:double>"
PROVENANCE = f"struct<page_number:int,bbox:{BOX},source:string,role:string,span:{SPAN},method:{METHOD},confidence:double>"
MOLECULE = f"struct<id:string,smiles:string,inchi:string,label:string,provenance:array<{PROVENANCE}>>"
COMPONENT = "struct<molecule_id:string,role:string>"
VALUE = "struct<value:double,units:string>"
REACTION = f"struct<id:string,components:array<{COMPONENT}>,yield_:{VALUE},temperature:{VALUE},duration:{VALUE},provenance:array<{PROVENANCE}>>"
PEAK = "struct<shift:double,multiplicity:string,integration:double,coupling_constants:array<double>>"
SPECTRUM = f"struct<id:string,type:string,molecule_id:string,nucleus:string,solvent:string,frequency:string,text_representation:string,raw_text:string,peaks:array<{PEAK}>,provenance:{PROVENANCE}>"
#: The root of an extraction record, as columns.
RECORD = f"source_filename string, molecules array<{MOLECULE}>, reactions array<{REACTION}>, spectra array<{SPECTRUM}>, errors array<string>"

#: Text lines, pictures, segments and tests of documents, as columns.
LINES = "doc_id bigint, seq bigint, page bigint, line bigint, text string"
PICTURES = "doc_id bigint, page bigint, det bigint, x double, y double, w double, h double, pic binary"
ERROR_RECORDS = "sim_score double, precision double, recall double, f1 double, TP bigint, FN bigint, FP bigint, gt_text string, ext_text string, gt_peaks array<double>, extracted_peaks array<double>"

SOURCES = ("text", "image", "table")
ROLES = ("structure_image", "label_text", "caption_text")


def valid_provenance(p):
    """Whether a provenance keeps the schema's limits: known source and role, confidence from 0 to 1. Null members are allowed."""
    from pyspark.sql import functions as F

    ok = lambda c: F.coalesce(c, F.lit(True))
    return ok(p["source"].isin(*SOURCES)) & ok(p["role"].isin(*ROLES)) & ok(p["confidence"].between(0, 1))
