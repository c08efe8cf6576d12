"""Manufacturer names by FIT number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The public manufacturer numbers of the FIT profile.
MANUFACTURERS = {
    1: "Garmin",
    2: "Garmin FR405 ANTFS",
    3: "Zephyr",
    4: "Dayton",
    5: "IDT",
    6: "SRM",
    7: "Quarq",
    8: "iBike",
    9: "Saris",
    10: "Spark HK",
    11: "Tanita",
    12: "Echowell",
    13: "Dynastream OEM",
    14: "Nautilus",
    15: "Dynastream",
    16: "Timex",
    17: "Metrigear",
    18: "Xelic",
    19: "Beurer",
    20: "Cardiosport",
    21: "A&D",
    22: "HMM",
    23: "Suunto",
    24: "Thita Elektronik",
    25: "GPulse",
    26: "Clean Mobile",
    27: "Pedal Brain",
    28: "Peaksware",
    29: "Saxonar",
    30: "LeMond Fitness",
    31: "Dexcom",
    32: "Wahoo Fitness",
    33: "Octane Fitness",
    34: "Archinoetics",
    35: "The Hurt Box",
    36: "Citizen Systems",
    37: "Magellan",
    38: "Osynce",
    39: "Holux",
    40: "Concept2",
    42: "One Giant Leap",
    43: "Ace Sensor",
    44: "Brim Brothers",
    45: "Xplova",
    46: "Perception Digital",
    47: "BF1systems",
    48: "Pioneer",
    49: "Spantec",
    50: "Metalogics",
    51: "4iiiis",
    52: "Seiko Epson",
    53: "Seiko Epson OEM",
    54: "Ifor Powell",
    55: "Maxwell Guider",
    56: "Star Trac",
    57: "Breakaway",
    58: "Alatech Technology Ltd",
    59: "MIO Technology Europe",
    60: "Rotor",
    61: "Geonaute",
    62: "ID Bike",
    63: "Specialized",
    64: "Wtek",
    65: "Physical Enterprises",
    66: "North Pole Engineering",
    67: "Bkool",
    68: "Cateye",
    69: "Stages Cycling",
    70: "Sigmasport",
    71: "TomTom",
    72: "Peripedal",
    73: "Wattbike",
    76: "Moxy",
    77: "Ciclosport",
    78: "Powerbahn",
    79: "Acorn Projects APS",
    80: "Lifebeam",
    81: "Bontrager",
    82: "Wellgo",
    83: "Scosche",
    84: "Magura",
    85: "Woodway",
    86: "Elite",
    87: "Nielsen Kellerman",
    88: "DK City",
    89: "Tacx",
    90: "Direction Technology",
    91: "Magtonic",
    92: "1partCarbon",
    93: "Inside Ride Technologies",
    94: "Sound Of Motion",
    95: "Stryd",
    96: "ICG",
    97: "MiPulse",
    98: "BSX Athletics",
    99: "Look",
    100: "Campagnolo SRL",
    101: "Body Bike Smart",
    102: "Praxisworks",
    103: "Limits Technology",
    104: "Topaction Technology",
    105: "Cosinuss",
    106: "Fitcare",
    107: "Magene",
    108: "Giant Manufacturing Co",
    109: "Tigrasport",
    110: "Salutron",
    111: "Technogym",
    112: "Bryton Sensors",
    113: "Latitude Limited",
    114: "Soaring Technology",
    115: "Igpsport",
    116: "Thinkrider",
    117: "Gopher Sport",
    118: "Waterrower",
    119: "Orangetheory",
    120: "Inpeak",
    121: "Kinetic",
    122: "Johnson Health Tech",
    123: "Polar Electro",
    124: "Seesense",
    125: "NCI Technology",
    126: "iQsquare",
    127: "Leomo",
    128: "iFit.com",
    129: "Coros Byte",
    130: "Versa Design",
    131: "Chileaf",
    132: "Cycplus",
    255: "Development",
    257: "Healthandlife",
    258: "Lezyne",
    259: "Scribe Labs",
    260: "Zwift",
    261: "Watteam",
    262: "Recon",
    263: "Favero Electronics",
    264: "Dynovelo",
    265: "Strava",
    266: "Precor",
    267: "Bryton",
    268: "SRAM",
    269: "Navman",
    270: "Cobi",
    271: "Spivi",
    272: "MIO Magellan",
    273: "Evesports",
    274: "Sensitivus Gauge",
    275: "Podoon",
    276: "Life Time Fitness",
    277: "Falco e-Motors",
    278: "Minoura",
    279: "Cycliq",
    280: "Luxottica",
    281: "TrainerRoad",
    282: "The Sufferfest",
    283: "Fullspeedahead",
    284: "Virtualtraining",
    285: "Feedbacksports",
    286: "Omata",
    287: "VDO",
    288: "Magneticdays",
    289: "Hammerhead",
    290: "Kinetic by Kurt",
    291: "Shapelog",
    292: "Dabuziduo",
    293: "Jetblack",
    294: "Coros",
    295: "Virtugo",
    296: "Velosense",
    297: "Cycligentinc",
    298: "Trailforks",
    299: "Mahle Ebikemotion",
    300: "Nurvv",
    301: "Microprogram",
    302: "Zone5cloud",
    303: "Greenteg",
    304: "Yamaha Motors",
    5759: "Actigraphcorp",
}


def manufacturer_table(spark: SparkSession) -> DataFrame:
    """(fit_manufacturer_id, known_name), for joins."""
    return spark.createDataFrame([*MANUFACTURERS.items()], "fit_manufacturer_id int, known_name string")
