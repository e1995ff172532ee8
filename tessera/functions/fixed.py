"""Word lists and tables whose values the results depend on. Fixed values, kept as plain text."""

LEGAL = """private pvt limited ltd llp llc inc incorporated lnc corp corporation co company plc pllc pc pa lp public esq
sarl sas sasu sa sci eurl gmbh""".split()
TITLES = "mr mrs ms dr sri shri smt the".split()
#: Legal forms and titles that are spelled letter by letter.
SPELLED = {"l l c": "llc", "l l p": "llp", "p c": "pc", "p a": "pa", "m s": "ms"}
ALIASES = ["d/b/a", "a/k/a", "t/a", "dba", "aka"]
DOMAIN_ENDINGS = ["co.in", "com", "in", "net", "org", "co", "fr", "biz", "info"]
JUNK_ADDRESS = ["null", "n a", "na", "none", "nan"]
ORDINALS = {
    w: str(k)
    for k, w in enumerate(
        """first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth
sixteenth seventeenth eighteenth nineteenth twentieth""".split(),
        1,
    )
}

FRENCH_LEGAL = """snc ei eirl scp selarl selas gie earl sca cie compagnie societe ste ets etablissements groupe fils freres and et
france de du des la le les l d""".split()
FRENCH_NAME_WORDS = {"5arl": "sarl", "5as": "sas", "frs": "freres", "et": "and"}
FRENCH_STREET_WORDS = {
    "r": "rue", "av": "avenue", "ave": "avenue", "st": "saint", "ste": "sainte", "all": "allee", "bd": "boulevard", "blvd": "boulevard",
    "bld": "boulevard", "imp": "impasse", "rte": "route", "crs": "cours", "q": "quai", "pl": "place", "ch": "chemin", "chem": "chemin",
    "res": "residence", "psg": "passage", "pass": "passage", "apt": "appartement", "app": "appartement", "appt": "appartement",
    "fbg": "faubourg", "sq": "square", "gal": "general", "mal": "marechal",
}
FRENCH_AREAS = ["hauts de france", "nouvelle aquitaine", "pays de la loire", "loire atlantique", "pas de calais", "gironde", "nord", "france"]
FRENCH_STREET_FILLERS = "no n de du des la le les l d".split()
#: Legal forms that a veto compares.
VETO_FORMS = "sarl sas sasu sa eurl sci snc ei eirl selarl scp gie earl".split()

#: Street types as address keys write them, words without meaning there, and words of units.
STREET_SHORT = {
    "avenue": "ave", "av": "ave", "boulevard": "blvd", "bd": "blvd", "bld": "blvd", "street": "st", "str": "st", "road": "rd", "drive": "dr",
    "lane": "ln", "court": "ct", "circle": "cir", "place": "pl", "terrace": "ter", "trail": "trl", "parkway": "pkwy", "highway": "hwy",
    "square": "sq", "rue": "r", "chemin": "ch", "route": "rte", "impasse": "imp", "allee": "all", "faubourg": "fbg", "quai": "q",
    "residence": "res", "north": "n", "south": "s", "east": "e", "west": "w", "mount": "mt", "point": "pt", "heights": "hts", "cove": "cv",
    "crossing": "xing", "saint": "st", "sainte": "ste", "floor": "fl", "building": "bldg", "suite": "ste", "apartment": "apt",
    "number": "no", "nagar": "ngr",
}
KEY_FILLERS = "de des du d l la le les a en of the and et no num numero n".split()
KEY_UNITS = "office flat plot shop unit fl bldg ste apt room block door house h floor sector ward survey sy gala".split()

#: Word classes of the change detector.
CHANGE_LEGAL = """llc inc incorporated corp corporation co company ltd limited pvt private llp lp pllc pc plc public
sarl sas sasu sa eurl sci snc ei eirl selarl scp gie earl gmbh ag bv nv""".split()
CHANGE_LEGAL_SHORT = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd", "private": "pvt"}
CHANGE_NOISE = """group groupe services service holdings holding partners enterprises enterprise industries international
solutions global associates associes fils cie developpement france india usa us america trading and et & +""".split()
CHANGE_TITLES = "mr mrs ms dr smt sri shri m s messrs the le la les".split()
CHANGE_KINDS_OF_PLACE = """amicale comite ecole club centre center association federation union syndicat societe cooperative
institute institut foundation fondation church eglise clinic clinique hospital hopital school college academy
academie restaurant cafe bar hotel pharmacie pharmacy bakery boulangerie garage auto studio salon""".split()
CHANGE_CITIES = "delhi mumbai bangalore kolkata chennai hyderabad pune paris".split()
CHANGE_STOP = "of de des du d l a en and et the".split()
CHANGE_UNITS = "unit fl floor bldg building suite ste apt apartment flat room block office door house h no".split()
CHANGE_CITY_AFFIXES = "city of town township village cdp borough county".split()
#: Letters that digits and signs stand for.
LEET = {"0": "o", "1": "l", "5": "s", "3": "e", "4": "a", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Ops that leave a name what it was.
NOISE_OPS = """n_domain n_acronym n_squash n_word_order n_leet n_upper n_lower n_case_other n_title n_acc_add
n_acc_strip n_legal_drop n_legal_dot n_legal_abbrev n_dblspace n_bracket n_hyphen n_comma_add
n_comma_drop n_amp_swap n_idtag n_tradingas""".split()
