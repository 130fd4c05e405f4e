"""The queries of this subpackage and their SQL."""

from .bpe import op11
from .decontaminate import OP3_SQL, op3
from .fill_middle import OP13_SQL, op13
from .html_text import op10
from .jaccard import OP8_SQL, op8
from .licenses import op6
from .lines import OP7_SQL, op7
from .packing import op4
from .perplexity import op1
from .reply_trees import OP5_SQL, op5
from .runs import op12
from .shards import op2
from .token_counts import op9

QUERIES = {"op1_perplexity": op1, "op2_shard": op2, "op3_decontaminate": op3, "op4_pack": op4, "op5_reply_trees": op5, "op6_licenses": op6, "op7_line_dedup": op7, "op8_jaccard": op8, "op9_token_counts": op9, "op10_html_text": op10, "op11_bpe": op11, "op12_runs": op12, "op13_fill_middle": op13}
ORACLES = {"op3_decontaminate": OP3_SQL, "op5_reply_trees": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_jaccard": OP8_SQL, "op13_fill_middle": OP13_SQL}
