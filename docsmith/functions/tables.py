"""Word lists and constants that results depend on."""

from __future__ import annotations

# Fixed values: (needle, system), in order of precedence.
SYSTEMS = [
    ("pathfinder second edition", "Pathfinder 2e"),
    ("pathfinder 2e", "Pathfinder 2e"),
    ("pathfinder", "Pathfinder 1e"),
    ("pzo", "Pathfinder 1e"),
    ("starfinder", "Starfinder"),
    ("call of cthulhu", "Call of Cthulhu"),
    ("shadowrun", "Shadowrun"),
    ("vampire the masquerade", "World of Darkness"),
    ("fifth edition", "D&D 5e"),
    ("5th edition", "D&D 5e"),
    ("dungeons & dragons", "D&D 5e"),
    ("dungeons and dragons", "D&D 5e"),
    ("d&d 5e", "D&D 5e"),
    ("5e", "D&D 5e"),
    ("3.5", "D&D 3.5e"),
    ("advanced dungeons", "AD&D"),
]

# Fixed values: (needle, document type), in order of precedence.
DOC_TYPES = [
    ("character sheet", "character sheet"),
    ("atelier", "generator"),
    ("generator", "generator"),
    ("random table", "random tables"),
    ("d100", "random tables"),
    ("bestiary", "bestiary"),
    ("menagerie", "bestiary"),
    ("monster manual", "bestiary"),
    ("monsters", "bestiary"),
    ("magic item", "magic items"),
    ("item compendium", "magic items"),
    ("spell", "spells"),
    ("battle map", "maps"),
    ("map pack", "maps"),
    ("player's handbook", "core rules"),
    ("dungeon master's guide", "core rules"),
    ("basic rules", "core rules"),
    ("system reference document", "core rules"),
    ("core rulebook", "core rules"),
    ("campaign setting", "setting"),
    ("gazetteer", "setting"),
    ("adventure path", "adventure"),
    ("adventure", "adventure"),
    ("module", "adventure"),
    ("one-shot", "adventure"),
    ("oneshot", "adventure"),
    ("dungeon", "adventure"),
    ("subclass", "character options"),
    ("subclasses", "character options"),
    ("race", "character options"),
    ("lineage", "character options"),
    ("background", "character options"),
    ("feats", "character options"),
    ("class", "character options"),
    ("sourcebook", "sourcebook"),
    ("supplement", "sourcebook"),
    ("handbook", "sourcebook"),
    ("compendium", "sourcebook"),
    ("guide", "sourcebook"),
]

# Settings, in order of precedence.
SETTINGS = [
    "Forgotten Realms",
    "Eberron",
    "Ravenloft",
    "Spelljammer",
    "Dragonlance",
    "Greyhawk",
    "Dark Sun",
    "Planescape",
    "Theros",
    "Ravnica",
    "Exandria",
    "Wildemount",
    "Strixhaven",
    "Golarion",
    "Faerun",
    "Faerûn",
]

# Fixed values: (needles, publisher), in order of precedence.
PUBLISHERS = [
    (["wizards of the coast"], "Wizards of the Coast"),
    (["paizo"], "Paizo"),
    (["dungeon masters guild", "dmsguild"], "DMs Guild"),
]

# Other spellings of a system, lower case.
ALIASES = {
    "d&d": "D&D 5e",
    "dnd": "D&D 5e",
    "d&d 5e": "D&D 5e",
    "d&d 5th edition": "D&D 5e",
    "dungeons & dragons": "D&D 5e",
    "dungeons and dragons": "D&D 5e",
    "dungeons & dragons 5e": "D&D 5e",
    "dungeons and dragons 5th edition": "D&D 5e",
    "dungeons & dragons 5th edition": "D&D 5e",
    "d&d 3.5e": "D&D 3.5e",
    "d&d 3.5": "D&D 3.5e",
    "d&d 4e": "D&D 4e",
    "ad&d": "AD&D",
    "pathfinder": "Pathfinder 1e",
    "pathfinder 1e": "Pathfinder 1e",
    "pathfinder 2e": "Pathfinder 2e",
    "pathfinder second edition": "Pathfinder 2e",
    "starfinder": "Starfinder",
    "cyberpunk red": "Cyberpunk Red",
    "cyberpunk 2020": "Cyberpunk 2020",
    "call of cthulhu": "Call of Cthulhu",
    "shadowrun": "Shadowrun",
    "gurps": "GURPS",
    "unknown": "System Neutral",
    "system neutral": "System Neutral",
    "systems neutral": "System Neutral",
    "generic": "System Neutral",
    "any": "System Neutral",
    "n/a": "System Neutral",
    "": "System Neutral",
}
NEUTRAL = "System Neutral"

# What marks an embedded title as left over from a program.
JUNK_TITLES = ["untitled", "microsoft word", "document1", ".indd", ".qxd", ".pdf", "layout", "diapositiva", "slide ", "presentation", "powerpoint", "print_cover", "final.doc"]

# Names that one system reserves for devices.
RESERVED = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]

# Limits and names.
MAX_COMPONENT = 180
UNSORTED = "_Unsorted"
LINE_TOLERANCE = 4.0
METADATA_OVERWRITE = 0.6
SKIP_DIRS = [".git", ".svn", "target", "node_modules", ".venv", "__pycache__"]
MODES = ["hardlink", "symlink", "copy", "move"]

# Why a document was left alone.
SKIPS = {
    "already_indexed": "already has a bookmark tree",
    "encrypted": "encrypted; cannot be rewritten",
    "too_short": "shorter than the page minimum",
    "no_headings": "no headings stand out from the body text",
    "unreadable": "could not be read: ",
}
