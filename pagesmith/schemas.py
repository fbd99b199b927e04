"""Explicit schemas; nothing is inferred."""

PAGES = "title string, namespace_id int, redirect_to string, body string, model string"
# Position of a page in the dumps: file, offset of the input split, row in the split.
ORD = "struct<file:string,block:bigint,row:bigint>"
RAW = f"ord {ORD}, title string, ns int, redirect string, model string, text string"
NAMESPACE_ENTRY = (
    "struct<id:int,name:string,content:boolean,aliases:array<string>,issubject:boolean,istalk:boolean>"
)
EDITS = "title string, namespace_id int, start int, end int, new string"
