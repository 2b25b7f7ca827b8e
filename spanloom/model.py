"""Schemas of transcripts, from nested documents to tables keyed by meeting."""

from __future__ import annotations

UNKNOWN = "SPEAKER_UNKNOWN"
WORD = "struct<word:string,start:double,end:double,score:double,speaker:string>"
SEGMENT = f"struct<speaker:string,start:double,end:double,text:string,words:array<{WORD}>,confidence:string,source:string>"
TRANSCRIPT = f"language string, duration double, segments array<{SEGMENT}>"
#: References also come as lists with other names for times.
REFERENCE_ITEM = "struct<speaker:string,start:string,start_sec:string,end:string,end_sec:string,text:string>"
