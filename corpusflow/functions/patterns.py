"""Ordered patterns that find an entry's fields in its text."""

from __future__ import annotations

#: Case-insensitive, dot matches line ends, Unicode classes and unix lines.
FLAGS = "(?isdU)"

# The patterns of each field for each style of source, in the order in which they are tried, in Java's syntax.
PATTERNS = {
    "list": {
        "launch_date": [
            r"launch\s+date[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"launched[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"launch[:\s]+([A-Za-z]+ \d{1,2},?\s+\d{4})",
        ],
        "end_date": [
            r"end\s+date[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"decommission(?:ed)?[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"mission end[:\s]+([A-Za-z0-9 ,/\-]+)",
        ],
        "objective": [
            r"objective[s]?[:\s]+(.+?)(?:\n\n|\z)",
            r"purpose[:\s]+(.+?)(?:\n\n|\z)",
            r"mission overview[:\s]+(.+?)(?:\n\n|\z)",
            r"goals?[:\s]+(.+?)(?:\n\n|\z)",
        ],
        "agency": [
            r"agency[:\s]+(.+?)(?:\n|\.)",
            r"managed by[:\s]+(.+?)(?:\n|\.)",
            r"lead center[:\s]+(.+?)(?:\n|\.)",
        ],
        "spacecraft": [
            r"spacecraft[:\s]+(.+?)(?:\n|\.)",
            r"satellite[:\s]+(.+?)(?:\n|\.)",
            r"vehicle[:\s]+(.+?)(?:\n|\.)",
        ],
        "orbit": [
            r"orbit(?:al)? (?:type|altitude|parameters?)[:\s]+(.+?)(?:\n|\.)",
            r"altitude[:\s]+(.+?)(?:\n|\.)",
            r"inclination[:\s]+(.+?)(?:\n|\.)",
        ],
        "instruments": [
            r"instrument[s]?[:\s]+(.+?)(?:\n\n|\z)",
            r"payload[s]?[:\s]+(.+?)(?:\n\n|\z)",
        ],
    },
    "cards": {
        "launch_date": [
            r"launch\s+date[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"launched[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"launch[:\s]+([A-Za-z]+ \d{1,2},?\s+\d{4})",
        ],
        "end_date": [
            r"end\s+date[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"decommission(?:ed)?[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"mission end[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"end of (?:mission|operations)[:\s]+([A-Za-z0-9 ,/\-]+)",
        ],
        "objective": [
            r"objective[s]?[:\s]+(.+?)(?:\n\n|\z)",
            r"purpose[:\s]+(.+?)(?:\n\n|\z)",
            r"mission overview[:\s]+(.+?)(?:\n\n|\z)",
            r"goals?[:\s]+(.+?)(?:\n\n|\z)",
            r"aims?\s+to\s+(.+?)(?:\.|$)",
        ],
        "agency": [
            r"agency[:\s]+(.+?)(?:\n|\.)",
            r"managed by[:\s]+(.+?)(?:\n|\.)",
            r"lead centre[:\s]+(.+?)(?:\n|\.)",
            r"lead center[:\s]+(.+?)(?:\n|\.)",
            r"prime contractor[:\s]+(.+?)(?:\n|\.)",
        ],
        "spacecraft": [
            r"spacecraft[:\s]+(.+?)(?:\n|\.)",
            r"satellite[:\s]+(.+?)(?:\n|\.)",
            r"vehicle[:\s]+(.+?)(?:\n|\.)",
            r"probe[:\s]+(.+?)(?:\n|\.)",
        ],
        "orbit": [
            r"orbit(?:al)? (?:type|altitude|parameters?)[:\s]+(.+?)(?:\n|\.)",
            r"altitude[:\s]+(.+?)(?:\n|\.)",
            r"inclination[:\s]+(.+?)(?:\n|\.)",
            r"sun[- ]synchronous orbit[:\s]*(.+?)(?:\n|\.)",
        ],
        "instruments": [
            r"instrument[s]?[:\s]+(.+?)(?:\n\n|\z)",
            r"payload[s]?[:\s]+(.+?)(?:\n\n|\z)",
            r"sensor[s]?[:\s]+(.+?)(?:\n\n|\z)",
        ],
        "launch_vehicle": [
            r"launch vehicle[:\s]+(.+?)(?:\n|\.)",
            r"launched (?:by|on|aboard)[:\s]+(.+?)(?:\n|\.)",
            r"rocket[:\s]+(.+?)(?:\n|\.)",
            r"(ariane\s*\d+[^.]*)",
            r"(vega[^.]*)",
            r"(soyuz[^.]*)",
        ],
    },
    "tables": {
        "launch_date": [
            r"launch\s+date[:\s]+([A-Za-z0-9 ,/\-]+)",
            r"launched[:\s]+([A-Za-z0-9 ,/\-]+)",
        ],
        "objective": [
            r"objective[s]?[:\s]+(.+?)(?:\n\n|\z)",
            r"purpose[:\s]+(.+?)(?:\n\n|\z)",
            r"mission overview[:\s]+(.+?)(?:\n\n|\z)",
        ],
        "agency": [
            r"agency[:\s]+(.+?)(?:\n|\.)",
            r"managed by[:\s]+(.+?)(?:\n|\.)",
        ],
        "spacecraft": [
            r"spacecraft[:\s]+(.+?)(?:\n|\.)",
            r"satellite[:\s]+(.+?)(?:\n|\.)",
        ],
        "orbit": [
            r"orbit(?:al)? (?:type|altitude)[:\s]+(.+?)(?:\n|\.)",
            r"altitude[:\s]+(.+?)(?:\n|\.)",
        ],
    },
}

#: The same with the flags that they are meant with.
FIELDS: dict[str, dict[str, list[str]]] = {style: {field: [FLAGS + p for p in patterns] for field, patterns in fields.items()} for style, fields in PATTERNS.items()}
