"""Vocabularies, lookup tables and orderings.

Everything in this file is a fixed value that results depend on.  Nothing here
is logic; the functions that use the tables live in ``functions`` and
``operators``.
"""

from __future__ import annotations

# --- canonical value sets -------------------------------------------------

MOTIVATIONS = ["financial", "espionage", "hacktivism", "destruction", "unknown"]

INDICATOR_TYPES = ["domain", "ip", "hash_md5", "hash_sha256", "hash_sha1", "url", "email"]

SECTORS = {
    "fin": "Finance", "financial": "Finance", "financial services": "Finance",
    "banking": "Finance", "bank": "Finance", "insurance": "Finance",
    "health": "Healthcare", "healthcare": "Healthcare", "medical": "Healthcare",
    "hospital": "Healthcare", "pharma": "Healthcare", "pharmaceutical": "Healthcare",
    "gov": "Government", "government": "Government", "public sector": "Government",
    "federal": "Government",
    "military": "Defense", "defense": "Defense", "defence": "Defense",
    "tech": "Technology", "technology": "Technology", "it": "Technology",
    "software": "Technology", "saas": "Technology",
    "energy": "Energy", "oil": "Energy", "gas": "Energy",
    "utilities": "Energy", "utility": "Energy",
    "telecom": "Telecommunications", "telecommunications": "Telecommunications",
    "telco": "Telecommunications",
    "retail": "Retail", "ecommerce": "Retail", "e-commerce": "Retail",
    "education": "Education", "academia": "Education", "university": "Education",
    "critical infrastructure": "Critical Infrastructure",
    "ics": "Critical Infrastructure", "ot": "Critical Infrastructure",
    "scada": "Critical Infrastructure",
    "transportation": "Transportation", "logistics": "Transportation",
    "aviation": "Transportation",
    "media": "Media", "news": "Media", "publishing": "Media",
    "hospitality": "Hospitality", "hotel": "Hospitality", "gaming": "Hospitality",
    "legal": "Legal", "law": "Legal",
    "ngo": "NGO / Non-profit", "nonprofit": "NGO / Non-profit", "non-profit": "NGO / Non-profit",
}

# --- indicator types ------------------------------------------------------

# spelling of an indicator type (lower case) -> canonical type
IOC_TYPE_ALIASES = {
    "ipv4": "ip", "ipv6": "ip",
    "md5": "hash_md5", "sha256": "hash_sha256", "sha1": "hash_sha1",
    "filehash-md5": "hash_md5", "filehash-sha256": "hash_sha256",
    "filehash-sha1": "hash_sha1", "file_hash": "hash_sha256",
    "hostname": "domain", "fqdn": "domain", "uri": "url",
}

# pulse indicator type (case-sensitive) -> canonical type
PULSE_IOC_TYPES = {
    "IPv4": "ip", "IPv6": "ip",
    "domain": "domain", "hostname": "domain", "URL": "url",
    "FileHash-MD5": "hash_md5", "FileHash-SHA1": "hash_sha1", "FileHash-SHA256": "hash_sha256",
    "email": "email", "CVE": "cve",
}

# family feed indicator type (lower case) -> canonical type
FAMILY_IOC_TYPES = {
    "ip:port": "ip", "domain": "domain", "url": "url",
    "md5_hash": "hash_md5", "sha256_hash": "hash_sha256",
}

THREAT_LABELS = {
    "botnet_cc": "Botnet C2",
    "payload": "Payload Delivery", "payload_delivery": "Payload Delivery",
    "cc": "Command & Control", "reconnaissance": "Reconnaissance",
}

THREAT_PRIORITY = {
    "botnet_cc": 0, "cc": 0, "payload_delivery": 1, "payload": 1, "reconnaissance": 2,
}

# export order of indicator types; the list is also the set of exportable types
EXPORT_TYPE_ORDER = [
    "ip", "domain", "url", "hash_md5", "hash_sha1",
    "hash_sha256", "email", "filepath", "mutex", "registry",
]

# order of indicator types inside a freshness block
BLOCKLIST_TYPE_ORDER = {
    "domain": 0, "ip": 1, "url": 2, "hash_md5": 3, "hash_sha256": 3, "hash_sha1": 3,
}
PAGE_TYPE_ORDER = {"domain": 0, "ip": 1, "url": 2}

# indicator type -> (pattern text before the value, pattern text after it)
PATTERN_PARTS = {
    "ip": ("[ipv4-addr:value = '", "']"),
    "domain": ("[domain-name:value = '", "']"),
    "url": ("[url:value = '", "']"),
    "hash_md5": ("[file:hashes.'MD5' = '", "']"),
    "hash_sha1": ("[file:hashes.'SHA-1' = '", "']"),
    "hash_sha256": ("[file:hashes.'SHA-256' = '", "']"),
    "email": ("[email-addr:value = '", "']"),
    "cve": ("[vulnerability:name = '", "']"),
}
IPV6_PATTERN_START = "[ipv6-addr:value = '"

# --- tactics, confidence, levels ------------------------------------------

TACTICS = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution",
    "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access",
    "Discovery", "Lateral Movement", "Collection", "Command and Control",
    "Exfiltration", "Impact",
]

CONFIDENCE_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
CONFIDENCE_COLOURS = {"HIGH": "#ff6666", "MEDIUM": "#ffaa00", "LOW": "#ffe680"}
CONFIDENCE_LAYER_SCORES = {"HIGH": 100, "MEDIUM": 60, "LOW": 30}
CONFIDENCE_NUMBERS = {"HIGH": 85, "MEDIUM": 50, "LOW": 15}

RULE_LEVEL_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "informational": 4}

# --- text hints -----------------------------------------------------------

# keyword in advisory text -> sector, in search order
ADVISORY_SECTOR_KEYWORDS = {
    "energy": "Energy", "electric": "Energy", "oil": "Energy", "gas": "Energy",
    "financial": "Financial Services", "bank": "Financial Services",
    "health": "Healthcare", "hospital": "Healthcare",
    "government": "Government", "federal": "Government",
    "defense": "Defense", "military": "Defense",
    "telecom": "Telecommunications", "transport": "Transportation", "water": "Water",
    "critical infra": "Critical Infrastructure", "manufacturing": "Manufacturing",
    "education": "Education", "academia": "Education",
}

# keyword in a pulse tag -> sector, in search order
PULSE_SECTOR_KEYWORDS = {
    "energy": "Energy", "oil": "Energy", "gas": "Energy",
    "financial": "Financial Services", "banking": "Financial Services",
    "healthcare": "Healthcare", "hospital": "Healthcare",
    "government": "Government", "defense": "Defense", "military": "Defense",
    "telecom": "Telecommunications", "transport": "Transportation",
    "water": "Water", "manufacturing": "Manufacturing", "education": "Education",
    "technology": "Technology", "aerospace": "Aerospace", "media": "Media",
    "ngo": "NGO", "think tank": "Think Tank",
}

# hint in text -> country, in search order
ORIGIN_HINTS = {
    "russia": "Russia", "soviet": "Russia",
    "china": "China", "prc": "China",
    "iran": "Iran",
    "dprk": "North Korea", "north korea": "North Korea",
}

COUNTRIES = {
    "RU": "Russia", "CN": "China", "IR": "Iran", "KP": "North Korea",
    "US": "United States", "UK": "United Kingdom", "IN": "India",
    "VN": "Vietnam", "BY": "Belarus",
}

# malware family tag -> class, first match wins
FAMILY_CLASSES = {
    "ransomware": "ransomware", "backdoor": "backdoor", "rootkit": "rootkit",
    "loader": "loader", "dropper": "loader",
    "infostealer": "infostealer", "stealer": "infostealer",
    "rat": "rat", "wiper": "wiper", "tool": "tool", "utility": "tool",
}

# graph export vocabularies
STIX_MOTIVATIONS = {
    "espionage": "espionage",
    "financial": "financial-gain", "financial crime": "financial-gain",
    "ideology": "ideology",
    "destruction": "dominance", "destructive": "dominance",
    "notoriety": "notoriety", "coercion": "coercion", "dominance": "dominance",
}
STIX_MALWARE_TYPES = {
    "backdoor": "backdoor", "ransomware": "ransomware", "rootkit": "rootkit",
    "loader": "dropper", "infostealer": "spyware", "rat": "remote-access-trojan",
    "wiper": "disk-eraser", "tool": "tool", "malware": "malware",
}

# curated group facts: group id -> (first seen, motivations, origin)
GROUP_SUPPLEMENT = {
    "G0007": ("2004", ["espionage"], "Russia"),
    "G0016": ("2008", ["espionage"], "Russia"),
    "G0032": ("2009", ["espionage", "financial crime"], "North Korea"),
    "G0045": ("2009", ["espionage"], "China"),
    "G0096": ("2012", ["espionage", "financial crime"], "China"),
    "G0034": ("2009", ["espionage", "destructive"], "Russia"),
    "G0010": ("2004", ["espionage"], "Russia"),
    "G0064": ("2013", ["espionage"], "Iran"),
    "G0049": ("2014", ["espionage"], "Iran"),
    "G0094": ("2012", ["espionage"], "North Korea"),
    "G0046": ("2013", ["financial crime"], "Eastern Europe"),
    "G1017": ("2021", ["espionage"], "China"),
}

# canonical actor -> slug used by one source, where a rule does not give it
FAMILY_SOURCE_SLUGS = {
    "APT28": "apt28", "APT29": "apt29", "APT41": "apt41",
    "Lazarus Group": "lazarus_group", "APT10": "apt10", "Sandworm": "sandworm",
    "Turla": "turla", "APT33": "apt33", "APT34": "apt34", "Kimsuky": "kimsuky",
    "FIN7": "fin7", "FIN8": "fin8", "Volt Typhoon": "volt_typhoon",
    "Equation Group": "equation_group",
}
PULSE_SOURCE_SLUGS = {
    "APT28": "APT28", "APT29": "APT29", "APT41": "APT41",
    "Lazarus Group": "Lazarus+Group", "APT10": "APT10", "Sandworm": "Sandworm",
    "Turla": "Turla", "APT33": "APT33", "APT34": "OilRig", "Kimsuky": "Kimsuky",
    "FIN7": "FIN7", "Volt Typhoon": "Volt+Typhoon", "Scattered Spider": "Scattered+Spider",
}
