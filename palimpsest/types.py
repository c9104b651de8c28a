"""Schemas and constants shared by all operators."""

from __future__ import annotations

ENTITY = "struct<text:string,type:string,start:int,end:int,confidence:double>"
ENTITIES = f"array<{ENTITY}>"
LEAK = "struct<kind:string,type:string,start:int,end:int>"
LEAKS = f"array<{LEAK}>"

PRIORITY = {"PER": 4, "LOC": 3, "ORG": 2, "MISC": 1}
LABELS = {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORGANIZATION", "MISC": "MISC"}
SECRET_TYPES = ("API_KEY", "JWT", "SECRET")
ALL_TYPES = ("PER", "LOC", "ORG", "MISC", "EMAIL", "IPV4", "IPV6", "IBAN", "SIRET", "SIREN", "PHONE", "API_KEY", "JWT", "SECRET")
OPEN, CLOSE, BLOCK = "⟦", "⟧", "█"
