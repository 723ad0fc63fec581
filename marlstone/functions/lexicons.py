"""Word lists, thresholds and patterns that results depend on, as they are defined."""

# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = (
    "ecc etc cioe cioè es p.es n.b nb dott sig sig.ra sira prof prof.ssa avv dr dr.ssa gg mm sec min ore n vol pag pp cap art "
    "cfr ca circa vs oz ibid all all' proff ing on n° num nr lit bd ed"
).split()

# Words of a sentence about its speaker.
FIRST_PERSON = (
    "io me mi mio mia miei mie noi ci nostro nostra nostri nostre ho sono sto ero avevo vado facio faccio fò fo penso credo "
    "preferisco voglio devo posso uso utilizzo prendo mangio bevo dormo lavoro abito vivo studio gioco leggo scrivo sento vedo "
    "alleno cammino corro nuoto farò faro userò usero andrò andro sarò saro avrei farei darei prenderei userei vorrei potrei "
    "dovrei abbiamo siamo stiamo vogliamo dobbiamo possiamo facciamo andiamo usiamo prendiamo vediamo useremo faremo andremo "
    "saremo avremo sceglieremo decidiamo scegliamo restiamo rimaniamo"
).split()

# Pairs of words of a sentence about its speaker.
FIRST_PERSON_PAIRS = ("mi serve", "mi servono", "mi piace", "mi piacciono", "mi sembra", "mi pare", "mi sento", "mi chiamo", "ho deciso", "ho scelto")

# Imperatives.
IMPERATIVES = (
    "fammi dimmi dammi mostrami spiegami aiutami trovami cercami scrivimi mandami inoltiami inviami leggimi aprimi chiudimi "
    "avviami fermami riavviami fai dai dì digli fagli dagli vai guarda ascolta prova usa cerca scrivi manda inoltra invia leggi "
    "apri chiudi avvia ferma riavvia spiega controlla verifica genera crea disegna mostra sentiti cercalo inizia comincia "
    "finisci smetti"
).split()

# Beginnings of requests.
REQUESTS = ("puoi", "potresti")
REQUEST_PAIRS = ("mi fai", "mi faresti", "mi puoi", "mi potresti", "puoi farmi", "potresti farmi", "puoi dirmi", "potresti dirmi")

# Beginnings, and words within the first five, of a sentence about the one spoken to.
ADDRESSED_FIRST = ("tu", "te", "hai", "sei", "stai", "puoi", "potresti")
ADDRESSED_AFTER_NOT = ("riesci", "sei", "hai", "stai", "puoi", "potresti")
ADDRESSED_ANY = ("ti", "puoi", "potresti", "useresti")

# Words that are no search keys.
STOPWORDS = (
    "il lo la i gli le un uno una di a da in con su per tra fra e o ma che chi cosa come quando dove the of and to is for on with "
    "how what"
).split()

# Function words of two languages; some are in both.
ITALIAN_WORDS = (
    "il la lo i le gli di a da in con su per tra fra e o ma se perche che chi cui quale un uno una è sono ho ha hai hanno abbiamo "
    "mi ti si ci vi questo questa questi queste quello quella come dove quando perché anche solo mio tuo suo nostro vostro loro"
).split()
ENGLISH_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can and or but if then "
    "because that which this these those with from for about into to of in on at by as i you he she it we they my your his her its "
    "our their"
).split()

# Fixed value: paragraphs that every page has.
BOILERPLATE = (
    r"scopo (puramente )?informativ|non sostituisce|consulta(re)? (il|un) medico|cookie|newsletter|tutti i diritti riservat|p\.? ?iva|privacy policy"
    r"|termini e condizioni|iscriviti|registrati|accedi al tuo account|spedizione gratuita|aggiungi al carrello|disclaimer"
)

# Signs of formulas, and a numbered equation's number.
MATH_SIGNS = "=≠≤≥≈≅<>+±×·⋅÷−–∞∑∏∫√∂∇∈∉∀∃∪∩∅⊂⊃⊆⊇∝∼→←↔⇒⇐⊕⊗∧∨¬"
EQUATION_NUMBER = r"^[\[(][A-Za-z]?\d+(?:\.\d+)+[\])]"

# What stands for a table or formula in the text that is rewritten.
PLACEHOLDERS = {
    "tabella": "[qui c'e' una tabella, riportata uguale nella nota sotto Materiale originale]",
    "formula": "[qui c'e' una formula, riportata uguale nella nota sotto Materiale originale]",
}
BLOCK = r"(?s)<!-- (tabella|formula) pag \d+ blocco \d+ -->\s*```.*?```"
