"""Token grammars of the checked languages.

They follow the public language references and read a little more than those allow: operators have little
precedence, and what needs names or types isn't checked. Rules marked ``§`` exist once for each place where
statements can stand: m (no function around), l (a loop there), f (a function), g (a loop in a function). In
their bodies ``§`` is that place, ``¤`` a loop in it, ``¶`` a function and ``µ`` no function.
"""

from __future__ import annotations

import re
from functools import cache

from codequarry.llm.derivatives import Grammar

JSON = """
value: 'true' | 'false' | 'null' | NUM | STR | '[' [value {',' value}] ']' | '{' [pair {',' pair}] '}'
pair: STR ':' value
"""

TOML = """
file: [line] {NL [line]}
line: key '=' value | '[' key ']' | '[' '[' key ']' ']'
key: simple {'.' simple}
simple: BARE | STR | INT | DATE | BOOL
value: STR | LONG | INT | FLOAT | DATE | BOOL | '[' nls [value nls {',' nls value nls} [',' nls]] ']' | '{' [pair {',' pair}] '}'
pair: key '=' value
nls: {NL}
"""

PYTHON = """
file: {stmtµ}
stmt§: line§ | compound§
line§: simple§ {';' simple§} [';'] NL
block§: NL INDENT stmt§ {stmt§} DEDENT | line§
leavem: 'NEVER'
leavel: 'break' | 'continue'
leavef: 'return' [exprs]
leaveg: leavel | leavef
simple§: leave§ | exprs | yielded | assign | 'pass' | 'raise' [expr ['from' expr]]
  | ('global' | 'nonlocal') name {',' name} | 'del' targets | 'assert' expr [',' expr] | import | 'type' name [tparams] '=' expr
assign: targets '=' {targets '='} (exprs | yielded) | single AUG (exprs | yielded) | single ':' expr ['=' (exprs | yielded)]
single: name | place | '(' single ')'
targets: starred {',' starred} [',']
starred: ['*'] target
target: name | place | '(' [targets] ')' | '[' [targets] ']'
place: atom {trailer} ('.' name | '[' slices ']')
trailer: '.' name | '[' slices ']' | '(' [args] ')'
name: ID | 'match' | 'case' | 'type'
text: STR | FSTR {field} FEND
field: FIELD (yielded | exprs) ['='] [CONV] [SPEC {field}] CLOSE
atom: name | NUM | text {text} | BYTES {BYTES} | 'None' | 'True' | 'False' | '...' | '(' [yielded | items] ')' | '[' [items] ']' | '{' [entries] '}'
items: item comp | item {',' item} [',']
item: '*' disj | named
named: name ':=' expr | expr
entries: expr ':' expr comp | entry {',' entry} [','] | items
entry: expr ':' expr | '**' disj
comp: compfor {compfor | 'if' disj | 'if' name ':=' disj}
compfor: ['async'] 'for' targets 'in' disj
args: named comp | pos {',' pos} {',' later} {',' last} [','] | kwarg {',' later} {',' last} [','] | '**' expr {',' last} [',']
pos: named | '*' expr
kwarg: name '=' expr
later: kwarg | '*' expr
last: kwarg | '**' expr
slices: slice {',' slice} [',']
slice: [expr] ':' [expr] [':' [expr]] | named | '*' disj
unary: {'-' | '+' | '~' | 'not'} ['await'] atom {trailer}
disj: unary {OP unary | operator unary}
operator: '+' | '-' | '*' | '**' | '/' | '@' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' ['not'] | '|'
expr: disj ['if' disj 'else' expr] | 'lambda' [lparams] ':' expr
lparams: name {',' name} [',' '/' {',' name}] {',' lopt} [',' lrest] [','] | name {',' name} ',' lopt {',' lopt} ',' '/' {',' lopt} [',' lrest] [',']
  | lopt {',' lopt} [',' '/' {',' lopt}] [',' lrest] [','] | lrest [',']
lopt: name '=' expr
lrest: '*' name {',' lkey} [',' '**' name] | '*' ',' lkey {',' lkey} [',' '**' name] | '**' name
lkey: name ['=' expr]
exprs: element {',' element} [',']
element: '*' disj | expr
yielded: 'yield' [exprs | 'from' expr]
import: 'import' dotted ['as' name] {',' dotted ['as' name]} | 'from' origin 'import' ('*' | alias {',' alias} | '(' alias {',' alias} [','] ')')
origin: dots {dots} [dotted] | dotted
dots: '.' | '...'
dotted: name {'.' name}
alias: name ['as' name]
compound§: 'if' named ':' block§ {'elif' named ':' block§} [else§] | 'while' named ':' block¤ [else§]
  | ['async'] 'for' targets 'in' exprs ':' block¤ [else§] | 'try' ':' block§ (handlers§ [else§] [finally§] | finally§)
  | ['async'] 'with' (with {',' with} | '(' with {',' with} [','] ')') ':' block§ | {'@' named NL} (['async'] def | class)
  | 'match' items ':' NL INDENT case§ {case§} DEDENT
else§: 'else' ':' block§
finally§: 'finally' ':' block§
handlers§: except§ {except§} ['except' ':' block§] | 'except' ':' block§ | group§ {group§}
except§: 'except' expr ['as' name] ':' block§
group§: 'except' '*' expr ['as' name] ':' block§
with: expr ['as' target]
def: 'def' name [tparams] '(' [params] ')' ['->' expr] ':' block¶
params: req {',' req} [',' '/' {',' req}] {',' opt} [',' rest] [','] | req {',' req} ',' opt {',' opt} ',' '/' {',' opt} [',' rest] [',']
  | opt {',' opt} [',' '/' {',' opt}] [',' rest] [','] | rest [',']
req: name [':' expr]
opt: name [':' expr] '=' expr
rest: '*' name [':' ['*'] expr] {',' key} [',' '**' req] | '*' ',' key {',' key} [',' '**' req] | '**' req
key: name [':' expr] ['=' expr]
tparams: '[' tparam {',' tparam} [','] ']'
tparam: ['*' | '**'] name [':' expr] ['=' expr]
class: 'class' name [tparams] ['(' [args] ')'] ':' blockµ
case§: 'case' patterns ['if' named] ':' block§
patterns: pattern {',' pattern} [',']
pattern: '*' name | closed {'|' closed} ['as' name]
closed: ['-'] NUM [('+' | '-') NUM] | STR {STR} | BYTES {BYTES} | 'None' | 'True' | 'False' | name {'.' name} ['(' [pargs] ')'] | '(' [patterns] ')' | '[' [patterns] ']'
  | '{' [mapped {',' mapped} [',']] '}'
pargs: parg {',' parg} [',']
parg: pattern | name '=' pattern
mapped: closed ':' pattern | '**' name
"""

GO = """
file: 'package' ID ';' {imports ';'} {top ';'}
imports: 'import' (import | '(' [import {';' import} [';']] ')')
import: [ID | '.'] STR
top: decl | 'func' [params] ID [tparams] signature [block]
decl: 'const' group_const | 'var' group_var | 'type' group_type
group_const: const | '(' [const {';' const} [';']] ')'
const: names [[type] '=' exprs]
group_var: var | '(' [var {';' var} [';']] ')'
var: names (type ['=' exprs] | '=' exprs)
group_type: typedef | '(' [typedef {';' typedef} [';']] ')'
typedef: ID [tparams] ['='] type
names: ID {',' ID}
tparams: '[' tparam {',' tparam} [','] ']'
tparam: names constraint
constraint: ['~'] type {'|' ['~'] type}
signature: params [params | type]
params: '(' [(named {',' named} [',' names '...' type] | names '...' type | type {',' type} [',' '...' type] | '...' type) [',']] ')'
named: names type
type: tname | literal_type | '*' type | '(' type ')'
tname: ID ['.' ID] ['[' type {',' type} [','] ']']
literal_type: '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | '<-' 'chan' type | 'func' signature
  | 'struct' '{' [field {';' field} [';']] '}' | 'interface' '{' [method {';' method} [';']] '}'
field: (names type | ['*'] tname) [STR]
method: ID signature | constraint
block: '{' stmts '}'
stmts: [stmt] {';' [stmt]}
stmt: decl | ID ':' [stmt] | simple | 'go' call | 'defer' call | 'return' [exprs] | 'break' [ID] | 'continue' [ID] | 'goto' ID | 'fallthrough' | block | if | for | switch | select
simple: exprs '=' exprs | expr AUG expr | names ':=' exprs | expr ('++' | '--' | '<-' expr) | call | '(' call ')' | '<-' unary
call: operand {suffix | body} '(' [(expr | type) {',' (expr | type)} ['...'] [',']] ')'
received: (exprs '=' | names ':=') '<-' unary
step: hexprs ('=' | AUG) hexprs | hexpr ['++' | '--' | '<-' hexpr]
head: names ':=' hexprs | step
if: 'if' [[head] ';'] hexpr block ['else' (if | block)]
for: 'for' [[head] ';' [hexpr] ';' [step] | hexpr | [exprs '=' | names ':='] 'range' hexpr] block
switch: 'switch' [[head] ';'] [head] '{' {('case' cases | 'default') ':' stmts} '}'
cases: (expr | type) {',' (expr | type)}
select: 'select' '{' {('case' (simple | received) | 'default') ':' stmts} '}'
exprs: expr {',' expr}
expr: unary {infix unary}
infix: OP | '+' | '-' | '^' | '&' | '*' | '|'
prefix: '+' | '-' | '!' | '^' | '&' | '*' | '<-'
unary: {prefix} operand {suffix | body}
hexprs: hexpr {',' hexpr}
hexpr: hunary {infix hunary}
hunary: {prefix} (ID | NUM | STR | '(' (expr | type) ')' | literal_type (body | '(' [expr] ')') | 'func' signature block) {suffix}
operand: ID | NUM | STR | '(' (expr | type) ')' | literal_type | 'func' signature block
suffix: '.' ID | '.' '(' (type | 'type') ')' | '[' (expr | type) {',' type} ']' | '[' [expr] ':' [expr] [':' expr] ']' | '(' [(expr | type) {',' (expr | type)} ['...'] [',']] ')'
body: '{' [element {',' element} [',']] '}'
element: [(expr | body) ':'] (expr | body)
"""

JAVA = """
unit: [{note} 'package' dotted ';'] {import} {typed | ';'}
import: 'import' ['static'] dotted ['.' '*'] ';'
dotted: ID {'.' ID}
note: '@' dotted ['(' [elem | ID '=' elem {',' ID '=' elem}] ')']
elem: expr | note | '{' [elem {',' elem}] [','] '}'
mod: note | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default'
  | 'sealed' | 'non-sealed'
typed: {mod} ('class' ID [tparams] ['extends' type] ['implements' types] ['permits' types] body
  | 'interface' ID [tparams] ['extends' types] ['permits' types] body | '@' 'interface' ID body
  | 'enum' ID ['implements' types] '{' [constant {',' constant}] [','] [';' {member}] '}'
  | 'record' ID [tparams] params ['implements' types] body)
constant: {note} ID [args] [body]
body: '{' {member} '}'
member: ';' | ['static'] block¶ | typed | {mod} [tparams] (type | 'void') ID params dims ['throws' types] (block¶ | ';' | 'default' elem ';')
  | {mod} [tparams] ID [params] ['throws' types] block¶ | {mod} type vars ';'
vars: var {',' var}
var: ID dims ['=' (expr | array)]
array: '{' [(expr | array) {',' (expr | array)}] [','] '}'
params: '(' [param {',' param}] ')'
param: {mod} type ['...'] (ID | 'this') dims
dims: {'[' ']'}
type: {note} (PRIM | ID [targs] {'.' ID [targs]}) dims
types: type {',' type}
targs: '<' [targ {',' targ}] '>'
targ: type | {note} '?' [('extends' | 'super') type]
tparams: '<' tparam {',' tparam} '>'
tparam: {note} ID ['extends' type {'&' type}]
block§: '{' {inner§} '}'
inner§: stmt§ | typed | {mod} type vars ';'
leavef: 'return' [expr] ';'
leaveg: leavef | ('break' | 'continue') [ID] ';'
stmt§: block§ | ';' | effect ';' | 'if' '(' expr ')' stmt§ ['else' stmt§] | 'while' '(' expr ')' stmt¤ | 'do' stmt¤ 'while' '(' expr ')' ';'
  | 'for' '(' ([{mod} type vars | effects] ';' [expr] ';' [effects] | {mod} type ID ':' expr) ')' stmt¤ | leave§ | 'throw' expr ';'
  | 'try' (block§ (catch§ {catch§} [finally§] | finally§) | '(' resource {';' resource} [';'] ')' block§ {catch§} [finally§])
  | switch¤ | 'synchronized' '(' expr ')' block§ | 'assert' expr [':' expr] ';' | ID ':' stmt¤ | 'yield' expr ';'
catch§: 'catch' '(' {mod} type {'|' type} ID ')' block§
finally§: 'finally' block§
resource: {mod} type ID '=' expr | expr
switch§: 'switch' '(' expr ')' '{' {('case' label {',' label} | 'default') (':' {inner§} | '->' (expr ';' | block§ | 'throw' expr ';'))} '}'
label: expr | 'default' | type ID
effects: effect {',' effect}
effect: place becomes expr | ('++' | '--') place | place ('++' | '--') | primary {suffix} args | 'new' creator
place: ID | primary {suffix} ('.' ID | '[' expr ']') | '(' place ')'
becomes: '=' | AUG | '>' '>=' | '>' '>' '>='
expr: place becomes expr | chain ['?' expr ':' expr] | lambda
chain: unary {(OP | '+' | '-' | '<' | '>' {'>'} ['>='] | '&' | '|' | '*') unary | 'instanceof' ['final'] type [ID]}
unary: {'+' | '-' | '~' | '!'} (('++' | '--') place | place ('++' | '--') | postfix | '(' type {'&' type} ')' (unary | lambda))
postfix: primary {suffix}
primary: ID | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' creator | switchf | (type | 'void') '.' 'class' | type '::' ('new' | ID)
creator: {note} (PRIM | ID [targs] {'.' ID [targs]}) (args [body] | '[' expr ']' {'[' expr ']'} dims | '[' ']' dims array)
suffix: '.' [targs] ID | '.' ('this' | 'class' | 'super') | '.' 'new' creator | '[' expr ']' | args | '::' ('new' | ID)
args: '(' [expr {',' expr}] ')'
lambda: (ID | '(' [ID {',' ID} | param {',' param}] ')') '->' (expr | block¶)
"""

ECMASCRIPT = """
module: {item}
item: import | export | stmtm
import: 'import' (STR | clause 'from' STR) ['with' object] ';'
clause: name [',' (space | imported)] | space | imported
space: '*' 'as' name
imported: '{' [ispec {',' ispec} [',']] '}'
ispec: name | (word | STR) 'as' name
named: '{' [spec {',' spec} [',']] '}'
spec: (word | STR) ['as' (word | STR)]
export: 'export' ('default' (func | class | <'function' 'class'> assign ';') | decl | named ['from' STR] ';' | '*' ['as' (word | STR)] 'from' STR ';')
decl: vars ';' | func | class
stmt§: sub§ | lexical ';' | func | class
leavem: 'NEVER'
leavel: ('continue' | 'break') [name] ';'
leavef: 'return' [exprs] ';'
leaveg: leavel | leavef
sub§: block§ | 'var' bind {',' bind} ';' | ';' | 'if' '(' exprs ')' sub§ ['else' sub§] | 'for' ['await'] '(' forhead ')' sub¤ | 'while' '(' exprs ')' sub¤
  | 'do' sub¤ 'while' '(' exprs ')' [';'] | leave§ | 'throw' exprs ';' | 'try' block§ (catch§ [finally§] | finally§)
  | 'switch' '(' exprs ')' '{' {'case' exprs ':' {stmt¤}} ['default' ':' {stmt¤} {'case' exprs ':' {stmt¤}}] '}' | name ':' (sub¤ | func) | 'debugger' ';'
  | <'{' 'function' 'class'> exprs ';'
catch§: 'catch' ['(' binding ')'] block§
finally§: 'finally' block§
forhead: [vars | exprs] ';' [exprs] ';' [exprs] | (('var' | 'let' | 'const') binding | place | pattern) ('of' assign | 'in' exprs)
vars: 'var' bind {',' bind} | lexical
lexical: 'let' bind {',' bind} | 'const' constant {',' constant}
bind: name ['=' assign] | constant
constant: target '=' assign
binding: target
target: name | '[' {','} [slot {',' [slot]}] ']' | '{' [field {',' field} [',']] '}'
slot: ['...'] target ['=' assign]
field: name ['=' assign] | propname ':' target ['=' assign] | '...' target
block§: '{' {stmt§} '}'
func: ['async'] 'function' ['*'] [name] params blockf
params: '(' [param {',' param} [',']] ')'
param: ['...'] target ['=' assign]
class: {decorator} 'class' [name] ['extends' lhs] '{' {member} '}'
decorator: '@' lhs
member: ';' | 'static' blockf | ['static'] ['async'] ['*'] propname params blockf | ['static'] ('get' | 'set') propname params blockf | ['static'] propname ['=' assign] ';'
propname: word | STR | NUM | PRIV | '[' assign ']'
exprs: assign {',' assign}
assign: chain ['?' assign ':' assign] | place ('=' | AUG | '>' '>=' | '>' '>' '>=') assign | pattern '=' assign | arrow | 'yield' [['*'] assign]
place: name | primary {suffix} ('.' (word | PRIV) | '[' exprs ']') | '(' exprs ')'
pattern: '[' {','} [slotted {',' [slotted]}] ']' | '{' [fielded {',' fielded} [',']] '}'
slotted: ['...'] (place | pattern) ['=' assign]
fielded: name ['=' assign] | propname ':' (place | pattern) ['=' assign] | '...' (place | pattern)
chain: binary {'??' binary} | binary {('||' | '&&') binary}
binary: power {operator power}
power: {update '**'} unary
operator: OP | '+' | '-' | '*' | '<' | '>' {'>'} ['>='] | 'in' | 'instanceof'
prefix: '+' | '-' | '~' | '!' | 'typeof' | 'void' | 'delete' | 'await'
unary: {prefix} update
update: ('++' | '--') place | place ('++' | '--') | lhs
arrow: ['async'] (name | params) '=>' (blockf | <'{'> assign)
lhs: {'new'} primary {suffix}
suffix: '.' (word | PRIV) | '?.' (word | PRIV | '[' exprs ']' | args) | '[' exprs ']' | args | template
args: '(' [arg {',' arg} [',']] ')'
arg: ['...'] assign
primary: name | NUM | STR | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false' | func | class | array | object | '(' exprs ')' | 'import' (args | '.' word)
  | 'new' '.' word | PRIV
array: '[' {','} [arg {',' [arg]}] ']'
object: '{' [prop {',' prop} [',']] '}'
prop: propname ':' assign | name | '...' assign | ['async'] ['*'] propname params blockf | ('get' | 'set') propname params blockf
template: TPL | HEAD exprs {MID exprs} TAIL
name: ID | 'of' | 'get' | 'set' | 'async' | 'from' | 'as'
"""

TYPESCRIPT = """
ispec: ['type'] (name | (word | STR) 'as' name)
import: 'import' (STR | ['type'] clause 'from' STR) ['with' object] ';' | 'import' name '=' exprs ';'
spec: ['type'] (word | STR) ['as' (word | STR)]
export: 'export' ('default' (func | class | interface | <'function' 'class'> assign ';') | decl | ['type'] named ['from' STR] ';' | ['type'] '*' ['as' (word | STR)] 'from' STR ';'
  | '=' exprs ';' | 'as' 'namespace' name ';')
decl: vars ';' | func | class | interface | alias | enum | space_decl | 'declare' (ambient | decl | 'global' '{' {item | ['export'] ambient} '}')
ambient: 'const' binding {',' binding} ';'
stmt§: sub§ | <'var'> decl
space_decl: ('namespace' | 'module') (name {'.' name} | STR) ('{' {item | ['export'] ambient} '}' | ';')
interface: 'interface' name [tparams] ['extends' tname {',' tname}] shape
alias: 'type' name [tparams] '=' type ';'
enum: ['const'] 'enum' name '{' [member_of {',' member_of} [',']] '}'
member_of: propname ['=' assign]
bind: name ['!'] [':' type] ['=' assign] | constant
constant: target [':' type] '=' assign
binding: target [':' type]
func: ['async'] 'function' ['*'] [name] [tparams] params [':' result] (blockf | ';')
param: {decorator} {'public' | 'private' | 'protected' | 'readonly' | 'override'} ['...'] (target | 'this') ['?'] [':' type] ['=' assign]
class: {decorator} ['abstract'] 'class' [name] [tparams] ['extends' lhs [targs]] ['implements' type {',' type}] '{' {member} '}'
member: ';' | 'static' blockf | {decorator} {mod} ['async'] ['*'] propname ['?'] [tparams] params [':' result] (blockf | ';')
  | {decorator} {mod} propname ['?' | '!'] [':' type] ['=' assign] ';' | {mod} '[' name ':' type ']' ':' type ';'
mod: 'public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'get' | 'set' | 'accessor'
binary: power {operator power | ('as' | 'satisfies') (type | 'const')}
prefix: '+' | '-' | '~' | '!' | 'typeof' | 'void' | 'delete' | 'await' | '<' (type | 'const') '>'
arrow: ['async'] (name | [tparams] params [':' result]) '=>' (blockf | <'{'> assign)
suffix: '.' (word | PRIV) | '?.' (word | PRIV | '[' exprs ']' | args) | '[' exprs ']' | args | template | '!' | targs (args | template)
prop: propname ':' assign | name | '...' assign | ['async'] ['*'] propname [tparams] params [':' result] blockf | ('get' | 'set') propname params [':' result] blockf
result: type | (name | 'this') 'is' type | 'asserts' (name | 'this') ['is' type]
type: union ['extends' union '?' type ':' type] | ['abstract'] ['new'] [tparams] params '=>' result
union: ['|' | '&'] part {('|' | '&') part}
part: {'keyof' | 'readonly' | 'unique' | 'infer'} base {'[' [type] ']'}
base: tname | STR | ['+' | '-'] NUM | template | 'null' | 'true' | 'false' | 'void' | 'typeof' tname | 'import' '(' STR ')' {'.' word} [targs]
  | '[' [slottype {',' slottype} [',']] ']' | shape | '(' type ')'
slottype: ['...'] [name ['?'] ':'] type ['?']
tname: (name | 'this') {'.' word} [targs]
targs: '<' type {',' type} [','] '>'
tparams: '<' tparam {',' tparam} [','] '>'
tparam: {'const' | 'in' | 'out'} name ['extends' type] ['=' type]
shape: '{' {sig (';' | ',')} [sig] '}'
sig: {'readonly'} propname ['?'] (':' type | [tparams] params [':' result]) | ['new'] [tparams] params [':' result] | {'readonly'} '[' name ':' type ']' ':' type
  | [['+' | '-'] 'readonly'] '[' name 'in' type ['as' type] ']' [['+' | '-'] '?'] [':' type] | ('get' | 'set') propname params [':' result] | {'readonly'} propname ['?']
name: ID | 'of' | 'get' | 'set' | 'async' | 'from' | 'as' | 'type' | 'namespace' | 'module' | 'declare' | 'readonly' | 'abstract' | 'keyof' | 'unique' | 'infer' | 'is'
  | 'asserts' | 'satisfies' | 'override' | 'accessor' | 'global' | 'out'
operator: OP | '+' | '-' | '*' | '<' | '>' {'>'} ['>='] | 'in' | 'instanceof' | '|' | '&'
"""


#: Where statements stand -> the same place within a loop.
PLACES = {"m": "l", "l": "l", "f": "g", "g": "g"}


def _in_places(rules: str, places: str = "mlfg") -> str:
    """Writes out the rules marked ``§``; see the top of this file."""
    out = []
    for name, mark, body in re.findall(r"^(\w+)(§?):((?:.|\n(?![\w]))*)", rules, re.M):
        for c in places if mark else " ":
            text = f"{name}{c if mark else ''}:{body}".replace("§", c).replace("¤", PLACES.get(c, ""))
            out.append(text.replace("¶", "f").replace("µ", "m"))
    return "\n".join(out)


def _with_words(rules: str) -> str:
    """Adds the rule ``word``: a name or any keyword."""
    words = sorted(t for t in Grammar(rules + "\nword: ID\n").literals if t.isalpha())
    return rules + "\nword: ID | " + " | ".join(f"'{w}'" for w in words) + "\n"


def _overlaid(base: str, more: str) -> str:
    """The rules of ``base`` with those of ``more`` in place of the same names."""
    rule = r"^(\w+§?):((?:.|\n(?![\w]))*)"
    rules = dict(re.findall(rule, base, re.M)) | dict(re.findall(rule, more, re.M))
    return "\n".join(f"{name}:{body}" for name, body in rules.items())


@cache
def grammar(language: str) -> Grammar:
    """The grammar of a language; one for each worker process, so its derivatives are shared by all files there."""
    if language == "javascript":
        operators = "operator: OP | '+' | '-' | '*' | '<' | '>' {'>'} ['>='] | 'in' | 'instanceof' | '|' | '&'\n"
        return Grammar(_with_words(_in_places(_overlaid(ECMASCRIPT, operators))))
    if language == "typescript":
        return Grammar(_with_words(_in_places(_overlaid(ECMASCRIPT, TYPESCRIPT))))
    if language == "java":
        return Grammar(_in_places(JAVA, "fg"))
    return Grammar(_in_places({"json": JSON, "toml": TOML, "python": PYTHON, "go": GO}[language]))
