"""Patterns, word lists and thresholds that decide results.

They are part of the behaviour users know, so they are kept together and plain.
Patterns are Java regular expressions, used case-insensitively through ``(?i)``.
"""

# text values that mean "no value" when a CSV file is read
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# conventional dates that mean "not yet"
PLACEHOLDER_DATE = (r"^(0{8}|0{4}-0{2}-0{2}|9999-?12-?31|1900-?01-?01|1899-?12-?3[01]|1970-?01-?01)"
                    r"(\b|T|\s|$)")

# time of day
TIME_TEXT = r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?(\.\d+)?$"
TIME_DIGITS = r"^\d{5,6}$"
TIME_NAME = r"(?i)(time|ora|orario|uhrzeit|zeit|_tm$|tm$|^cputm|^erzet|^aezet|^utime|^uzeit|zet$)"

# column names
ID_NAME = (r"(?i)(^id$|_id$|^id_|number|numero|_no$|_nr$|^nr|code|codice|key|chiave|^num|"
           r"belnr|ebeln|ebelp|vbeln|posnr|buzei|gjahr|mblnr|zeile|bukrs|kunnr|lifnr|matnr)")
DECIMAL_TEXT = r"^-?\d+[.,]\d+$"
ACTIVITY_NAME = (r"(?i)(activit|attivit|action|azione|event|step|fase|phase|status|stato|state|^type$|_type$|"
                 r"^tipo|_tipo|operation|operazion|causal|movement|moviment|transaction|transazion|change|"
                 r"vgabe|bewtp|bwart|blart|vorgang|tcode)")
STRONG_ACTIVITY_NAME = (r"(?i)(activit|attivit|event|action|azione|operation|operazion|^step|_step|task|"
                        r"vorgang|concept:name)")
REASON_NAME = r"(?i)(reason|motiv|grund|rstgr|abgru|^cause$|_cause$|^causa$|_causa$)"
TYPE_NAME = r"(?i)(type|tipo|kind|categor|class|blart|auart|fkart|bsart|vbtyp|koart|record_?type|doc_?type)"
DAYS_NAME = r"(?i)(days|giorni|tage|ztag|zbd\dt|^gg|_gg$|ggpag|term_?days|net_?days|payment_?days)"
USER_NAME = (r"(?i)(user|utente|ernam|usnam|aenam|_by$|owner|operator|operatore|agent|person|name|nome|"
             r"resource|risorsa)")

# change logs: names of the columns that hold the field, its old and its new value
CHANGE_FIELD = (r"(?i)^(fname|field|field_?name|fieldname|changed_?field|attribute|attribute_?name|campo|"
                r"nome_?campo)$")
CHANGE_OLD = (r"(?i)^(value_?old|old_?val(ue)?|oldvalue|prev(ious)?_?val(ue)?|from_?val(ue)?|"
              r"valore_?(vecchio|precedente))$")
CHANGE_NEW = r"(?i)^(value_?new|new_?val(ue)?|newvalue|to_?val(ue)?|valore_?nuovo)$"
OPPOSITES = [("SET", "REMOVE"), ("SET", "RESET"), ("ADD", "REMOVE"), ("ADD", "DELETE"), ("BLOCK", "UNBLOCK"),
             ("LOCK", "UNLOCK"), ("ASSIGN", "UNASSIGN"), ("IMPOSTA", "RIMUOVI"), ("APERTURA", "CHIUSURA")]

# dates that are planned or due, by column code and by name
PLANNED_CODES = ["ZFBDT", "NETDT", "FAEDT", "EINDT", "SLFDT", "LFDAT", "VDATU", "WADAT", "MBDAT", "KDATB",
                 "KDATE", "DATAB", "DATBI"]
PLANNED_NAME = (r"(?i)(due|scaden|deadline|expir|planned|^plan_|_plan|previst|expected|target|promised|requested|"
                r"richiest|baseline|valid_?(from|to|until)|validit|forecast|estimated|stimat|^eta$|^eta_|_eta$)")

# users, technical users and changes, by name
USER_ATTRIBUTE = (r"(?i)user|usnam|uname|ernam|aenam|created_?by|changed_?by|utente|operat|resource|risorsa|agent")
TECHNICAL_USER = (r"(?i)batch|system|^sys|rfc|^wf|workflow|job|auto|edi|idoc|interface|^api|srv|svc|service|bot|"
                  r"robot|sched|cron|daemon|integrat")
CHANGE_ACTIVITY = (r"(?i)^(set|remove|change|update|modify|edit|amend|correct|cancel|reverse|delete|block|unblock|"
                   r"release|imposta|rimuovi|modifica|aggiorna|correggi|annulla|storna|elimina|blocca|sblocca)\b"
                   r"|\b(change|modific|storno|reversal|cancell|annull)")
DISPLAY_NAME = r"(?i)name|nome|descr|bezeich|text|testo|title|titolo"
ROLE_ATTRIBUTE = (r"(?i)(^|[_:\s.\-])(role|ruolo|department|dept|reparto|funzione|function|team|group|gruppo|"
                  r"unit|unita|ufficio|office|abteilung|area|division|divisione)($|[_:\s.\-])")

HOME = "involves"        # qualifier of the link between an event and the object of its own row
START, END = "__start__", "__end__"
EMPTY_LABEL = "(empty)"

# profile
COVERAGE_WARN, MIN_CONTAINMENT, MAX_PAIR_COLUMNS = 0.95, 0.5, 8
MAX_TYPE_VALUES, MAX_ACTIVITY_VALUES, MAX_DOMAIN_VALUES = 20, 40, 200
FUTURE_SHARE, OFFSET_ROWS, OFFSET_DAYS = 0.2, 10, 7
# quality
START_OBJECTS, START_SHARE = 5, 0.5
# log model
HUB_AVERAGE, HUB_RATIO, LIFECYCLE_AVERAGE = 8, 4, 1.5
FILTER_VALUES = 2000
HISTOGRAM_BINS = 12
CATEGORY_VALUES = 12
DAY = 86400.0
# root cause
MIN_CASES, MIN_SHARE, MIN_BAD, MIN_MEASURED = 20, 0.03, 15, 40
MIN_LIFT, MIN_DIFF, MIN_DAYS, MIN_REL = 1.5, 0.05, 2.0, 0.2
Q_MAX, STABLE_LIFT, MAX_VALUES, MAX_FINDINGS = 0.05, 1.15, 30, 5
PAIR_POOL, PAIR_GAIN, SAME_CASES = 20, 1.3, 0.8
# conformance
EXTRA_ACTIVITIES, EXTRA_EDGES, MAX_ROLES = 12, 40, 8
# ad-hoc queries
SAMPLE_ROWS, GROUPS_SHOWN, SAMPLE_COLUMNS, CELL_CHARS = 20, 40, 15, 80
# document excerpts
CHUNK_CHARS, EXCERPT_CHARS = 700, 2500
