"""Word lists and patterns of the question language (Portuguese)."""

from __future__ import annotations

# Fixed values that results depend on: stopwords and question filler.
STOPWORDS = (
    "a ao aos as ate com como da das de do dos e em era eram essa esse esta este eu foi for isso isto ja la lhe lo mais mas me mesmo meu "
    "minha na nao nas nem no nos nossa o os ou para pela pelo por qual quando que quem se sem seu sua sao so tambem te tem tendo ter teu "
    "teve tinha tive tu um uma uns umas voce voces vos"
).split()
FILLER = (
    "me explica explique diz diga fala fale quero saber pode poderia gostaria sobre qual quais quanto quantos quantas onde como por porque "
    "pq o a os as de do da em no na que eh seria pra para pfv trata"
).split()
# Fixed values that results depend on: question words that a frame leaves out.
LIGHT = ("fazer", "ser", "sobre", "trata", "tratar")
WORK = ("trabalha", "trabalham")

# Fixed patterns of questions, over folded text.
DEFINITION = r"\b(do que se trata|o que (e|eh)|quem (e|eh)|o que faz)\b"
QUANTITY = r"\b(quanto|quantos|quantas|ganh\w*|fatur\w*|receita|valor|lucro)\b"
PEOPLE = r"\b(funcionari\w*|colaborador\w*|pessoas|pessoa|headcount|trabalh\w+|quadro de pessoal)\b"
YEAR = r"\b(20\d{2})\b"
PERIOD = r"\b(?:na|no|em)?\s*([pq])\s*([1-4])(?:\s+de)?\s+(20\d{2})\b"
INCIDENT = r"\b(p1-\d{4}-\d+|incidente|severidade|postmortem|ack)\b"
HOWTO = r"\b(como (fazer|executar|rodar|aplicar|montar)|passo a passo|checklist|procedimento)\b"

# Fixed patterns of tables.
MONTH = "jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez"
PERIOD_LABEL = rf"^(fy\s*20\d{{2}}|q[1-4](\s*20\d{{2}})?|p[1-4](\s*20\d{{2}})?|r12\b.*|({MONTH})\s*/\s*20\d{{2}}|20\d{{2}}|δ|delta)$"
DATE_CELL = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"
SEPARATOR_ROW = r"^\s*\|?\s*:?-{2,}.*\|"

# Fixed patterns of answer sentences.
SPECIFIC = (
    r"(?i)(\d|r\$|%|prazo|deve|devem|obrigat|vedad|proibid|mínim|minim|máxim|maxim|até |ate |após|apos |vedado|permitid|antecedência|"
    r"antecedencia|dias|horas|reais)"
)
GENERIC = r"(?i)^(veja também|introdução|neste documento|o presente)\b"
HOWTO_STEP = r"(?i)(^\s*\d+[\.\)]|execute|obrigat|proibid|checklist|pare\b|deve|devem)"
MONEY = r"(?i)r\$|\bmi\b"
