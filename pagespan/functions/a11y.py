"""Accessibility vocabularies and conformance profiles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import lit, string

# The 1.0 profile's address, without scheme and www.
PROFILE_10 = "idpf.org/epub/a11y/accessibility-20170105.html#wcag-"
CANONICAL_10 = "http://www." + PROFILE_10
# Known terms; any other spelling is kept as it is.
ACCESS_MODES = ("auditory", "chartOnVisual", "chemOnVisual", "colorDependent", "diagramOnVisual", "mathOnVisual", "musicOnVisual", "tactile", "textOnVisual", "textual", "visual")
PRIMARY_MODES = ("auditory", "tactile", "textual", "visual")
HAZARDS = ("none", "flashing", "noFlashingHazard", "motionSimulation", "noMotionSimulationHazard", "sound", "noSoundHazard", "unknown")
FEATURES = (
    "annotations", "ARIA", "bookmark", "index", "pageBreakMarkers", "pageNavigation", "readingOrder", "structuralNavigation", "tableOfContents", "taggedPDF", "alternativeText", "audioDescription", "captions", "describedMath",
    "longDescription", "rubyAnnotations", "signLanguage", "transcript", "displayTransformability", "synchronizedAudioText", "timingControl", "unlocked", "ChemML", "latex", "MathML", "ttsMarkup", "highContrastAudio",
    "highContrastDisplay", "largePrint", "braille", "tactileGraphic", "tactileObject", "none",
)
EXEMPTIONS = ("eaa-microenterprise", "eaa-fundamental-alteration", "eaa-disproportionate-burden")
_TEXT = r"^EPUB Accessibility (.+?) - WCAG (.+?) Level (.*\S.*)$"


def normal_profile(raw: Column | str) -> Column:
    """A conformsTo value in its canonical spelling; null if it is no known profile."""
    s = F.trim(F.regexp_replace(string(raw), r"(?U)\s+", " "))
    level = F.regexp_extract(s, r"^https?://(?:www\.)?\Q" + PROFILE_10 + r"\E(a|aa|aaa)$", 1)
    return F.when(level != "", F.concat(lit(CANONICAL_10), level)).when(s.rlike(_TEXT), s)


def profile_rank(profile: Column | str) -> Column:
    """1 to 3 for the 1.0 levels; from 4 on by WCAG version and level; 255 for others."""
    s = string(profile)
    version, level = F.regexp_extract(s, _TEXT, 2), F.trim(F.regexp_extract(s, _TEXT, 3))
    base = F.when(version == "2.0", 0).when(version == "2.1", 3).when(version == "2.2", 6).otherwise(9)
    step = F.when(level == "A", 0).when(level == "AA", 1).when(level == "AAA", 2).otherwise(3)
    return F.when(s == CANONICAL_10 + "a", 1).when(s == CANONICAL_10 + "aa", 2).when(s == CANONICAL_10 + "aaa", 3).when(s.rlike(_TEXT), base + step + 4).otherwise(255)


def is_known(term: Column | str, vocabulary: tuple[str, ...]) -> Column:
    return string(term).isin(*vocabulary)
