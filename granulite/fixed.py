"""Tables and constants that results must agree on."""

# fixed values: error dictionary, code -> operator text
ERROR_MESSAGES = {
    "E1111": "Kamera csatlakozási hiba",
    "E1201": "Asztalvezérlő csatlakozási hiba",
    "E1311": "Kamera profil (.pfs) betöltése sikertelen",
    "E1312": "Beállítás fájl (.tss) betöltése sikertelen",
    "E2000": "Hiányzó tabletta",
    "E2002": "Túl alacsony expozíciós idő",
    "E2003": "Túl magas expozíciós idő",
    "E2004": "Tabletta pozíció nem megfelelő",
    "E2005": "Képelemzési hiba: E2005",
    "E2006": "Képelemzési hiba: E2006",
    "E2007": "Képelemzési hiba: E2007",
    "E2008": "Képelemzési hiba: E2008",
    "E2009": "Képelemzési hiba: E2009",
    "E2010": "Képelemzési hiba: E2010",
    "E2011": "Képelemzési hiba: E2011",
    "E2012": "Képelemzési hiba: E2012",
    "E2013": "Képelemzési hiba: E2013",
    "E2014": "Képelemzési hiba: E2014",
    "E2015": "Képelemzési hiba: E2015",
    "E2200": "Képelemzési hiba: E2200",
    "E2201": "Képelemzési hiba: E2201",
    "E2205": "Képelemzési hiba: E2205",
    "E2206": "Képelemzési hiba: E2206",
    "E2207": "Képelemzési hiba: E2207",
    "E2112": "Képelemzési hiba: E2112",
    "E2110": "Képelemzési hiba: E2110",
    "E2113": "Képelemzési hiba: E2113",
    "E2114": "Képelemzési hiba: E2114",
    "GENERIC": "Váratlan hiba lépett fel",
}

LAST_RESORT_MESSAGE = "An error occurred."

# fixed values: travel limits per axis
AXIS_LIMITS = {"x": (0.0, 175.0), "y": (0.0, 175.0), "z": (0.0, 30.0)}

# fixed values: words that mark a lost serial link or camera (matched in lower case)
SERIAL_LOSS_WORDS = ("serialexception", "writefile failed", "permissionerror",
                     "clearcommerror", "device", "usb")
CAMERA_LOSS_WORDS = ("camera not ready", "camera disconnected", "grab failed",
                     "failed to grab", "physically removed", "not open",
                     "camera is not grabbing")

# fixed values: the same for response details (matched with case)
SERIAL_LOSS_DETAILS = ("SerialException", "PermissionError", "WriteFile failed", "ClearCommError")
CAMERA_LOSS_DETAILS = ("Camera not ready", "Camera disconnected", "Grab failed",
                       "Failed to grab", "physically removed", "not open")

# fixed values: codes whose frames are archived, per check
ARCHIVE_CODES = {"automatic": ("E2008", "E2009", "E2010", "E2011", "E2015"),
                 "manual": ("E2012", "E2015")}

# fixed values: run-start messages, first failing rule wins
RUN_MESSAGES = {
    "both": "Kamera és mozgásplatform nincs csatlakoztatva.",
    "camera": "Kamera nincs csatlakoztatva.",
    "motion": "Mozgásplatform nincs csatlakoztatva.",
    "folder": "Válasszon mentési helyet.",
    "name": "Adja meg a mérés nevét.",
    "light": "Válasszon legalább egy világítási módot.",
    "tablets": "Válasszon legalább egy tablettát.",
}

# fixed values: grid and first-cell defaults
GRID_N = 10
FIRST_X, FIRST_Y, FIRST_Z, SPACING = 2.9, 10.6, 20.0, 18.3

PASS_MARK, FAIL_MARK = "✔︎", "✖︎"
IMAGE_KINDS = ("dome", "dome_masked", "bar", "bar_masked")
EPS = 1e-6
